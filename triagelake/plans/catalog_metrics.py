"""Metrics, feedback, rules, costs, compliance: queries and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from triagelake.operators import cache, compliance, costs, feedback, findings, metrics, rules
from triagelake.plans.registry import query
from triagelake.session import work_dir
from triagelake.sinks import exports
from triagelake.sources import tables

_JUDGED = (
    "judged AS (SELECT fb.id, fb.finding_id, fb.feedback_type, fb.created_at, f.scan_job_id, f.language, f.tool, "
    "f.rule_id, f.severity FROM feedback fb JOIN findings f ON fb.finding_id = f.id)"
)
_KINDS = (
    "count(*) FILTER (WHERE feedback_type = 'true_positive') AS true_positives, "
    "count(*) FILTER (WHERE feedback_type = 'false_positive') AS false_positives, "
    "count(*) FILTER (WHERE feedback_type = 'false_negative') AS false_negatives, "
    "count(DISTINCT finding_id) AS total_findings, count(DISTINCT scan_job_id) AS total_scans"
)


def _scores(inner: str, keep: str) -> str:
    """SQL for precision, recall and F1 over a counts subquery."""
    return (
        f"SELECT {keep} true_positives, false_positives, false_negatives, total_findings, total_scans, "
        "round(p, 6) AS precision, round(r, 6) AS recall, "
        "round(CASE WHEN p + r = 0 THEN NULL ELSE 2 * p * r / (p + r) END, 6) AS f1_score FROM ("
        "SELECT *, CASE WHEN true_positives + false_positives = 0 THEN NULL ELSE "
        "CAST(true_positives AS DOUBLE) / (true_positives + false_positives) END AS p, "
        "CASE WHEN true_positives + false_negatives = 0 THEN NULL ELSE "
        "CAST(true_positives AS DOUBLE) / (true_positives + false_negatives) END AS r "
        f"FROM ({inner}) c) s"
    )


_SCORE_COLS = [
    "true_positives",
    "false_positives",
    "false_negatives",
    "total_findings",
    "total_scans",
    "precision",
    "recall",
    "f1_score",
]


def _judged(t):
    return metrics.judged_findings(t.feedback, t.findings)


# ---------------------------------------------------------------- metrics


@query(
    "a01_precision_by_rule",
    f"WITH {_JUDGED} SELECT rule_id, round(CASE WHEN tp + fp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) "
    "AS precision FROM (SELECT rule_id, count(*) FILTER (WHERE feedback_type = 'true_positive') tp, "
    "count(*) FILTER (WHERE feedback_type = 'false_positive') fp FROM judged GROUP BY rule_id) c",
    "feedback findings",
)
def _(t):
    return metrics.scores_by(_judged(t), ["rule_id"], 6).select("rule_id", "precision")


@query(
    "a02_recall_by_rule",
    f"WITH {_JUDGED} SELECT rule_id, round(CASE WHEN tp + fn = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) "
    "AS recall FROM (SELECT rule_id, count(*) FILTER (WHERE feedback_type = 'true_positive') tp, "
    "count(*) FILTER (WHERE feedback_type = 'false_negative') fn FROM judged GROUP BY rule_id) c",
    "feedback findings",
)
def _(t):
    return metrics.scores_by(_judged(t), ["rule_id"], 6).select("rule_id", "recall")


@query(
    "a03_f1_by_finding_job",
    f"WITH {_JUDGED} "
    + _scores(f"SELECT scan_job_id, {_KINDS} FROM judged GROUP BY scan_job_id", "scan_job_id,").replace(
        "SELECT scan_job_id, true_positives, false_positives, false_negatives, total_findings, total_scans, "
        "round(p, 6) AS precision, round(r, 6) AS recall, ",
        "SELECT scan_job_id, ",
    ),
    "feedback findings",
)
def _(t):
    return metrics.scores_by(_judged(t), ["scan_job_id"], 6).select("scan_job_id", "f1_score")


@query(
    "a04_metrics_summary",
    f"WITH {_JUDGED} SELECT *, 0 AS true_negatives FROM ("
    + _scores(f"SELECT {_KINDS} FROM judged", "")
    + ") z",
    "feedback findings",
)
def _(t):
    out = metrics.scores_by(_judged(t), [], 6)
    return out.select(*_SCORE_COLS, F.col("true_negatives").cast("int").alias("true_negatives"))


@query(
    "a05_metrics_by_language",
    f"WITH {_JUDGED} " + _scores(f"SELECT language, {_KINDS} FROM judged GROUP BY language", "language,"),
    "feedback findings",
)
def metrics_by_language(t):
    return metrics.scores_by(_judged(t), ["language"], 6).select("language", *_SCORE_COLS)


for _period, _unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month")):

    @query(
        f"a06_metrics_timeseries_{_period}",
        f"WITH {_JUDGED} "
        + _scores(
            f"SELECT strftime(date_trunc('{_unit}', created_at), '%Y-%m-%d') AS day, {_KINDS} FROM judged GROUP BY 1",
            "day,",
        ),
        "feedback findings",
    )
    def _(t, period=_period):
        out = metrics.scores_by_period(t.feedback, t.findings, period, 6)
        return out.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), *_SCORE_COLS)


@query(
    "a07_metrics_by_tool",
    f"WITH {_JUDGED} " + _scores(f"SELECT tool, {_KINDS} FROM judged GROUP BY tool", "tool,"),
    "feedback findings",
)
def _(t):
    return metrics.scores_by(_judged(t), ["tool"], 6).select("tool", *_SCORE_COLS)


@query(
    "a08_metrics_by_severity",
    f"WITH {_JUDGED} " + _scores(f"SELECT severity, {_KINDS} FROM judged GROUP BY severity", "severity,"),
    "feedback findings",
)
def _(t):
    return metrics.scores_by(_judged(t), ["severity"], 6).select("severity", *_SCORE_COLS)


@query(
    "a08_metrics_all_dimensions",
    f"WITH {_JUDGED}, long AS (SELECT *, 'language' AS dimension, language AS label FROM judged UNION ALL "
    "SELECT *, 'tool', tool FROM judged UNION ALL SELECT *, 'severity', severity FROM judged) "
    + _scores(f"SELECT dimension, label, {_KINDS} FROM long GROUP BY 1, 2", "dimension, label,"),
    "feedback findings",
)
def _(t):
    return metrics.scores_by_dimension(_judged(t), 6).select("dimension", "label", *_SCORE_COLS)


@query(
    "p10_metrics_filtered",
    f"WITH {_JUDGED} "
    + _scores(
        f"SELECT rule_id, {_KINDS} FROM judged WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND "
        "created_at <= TIMESTAMP '2024-01-20 12:00:00' AND language = 'python' AND tool = 'bandit' AND "
        "severity = 'HIGH' GROUP BY rule_id",
        "rule_id,",
    ),
    "feedback findings",
)
def _(t):
    judged = metrics.judged_findings(
        metrics.filter_window(t.feedback, datetime(2024, 1, 5), datetime(2024, 1, 20, 12)),
        metrics.filter_window(t.findings, language="python", tool="bandit", severity="HIGH"),
    )
    return metrics.scores_by(judged, ["rule_id"], 6).select("rule_id", *_SCORE_COLS)


@query(
    "k05_metrics_export_rows",
    f"WITH {_JUDGED} SELECT timestamp, precision, recall, f1_score FROM ("
    + _scores(
        f"SELECT strftime(date_trunc('day', created_at), '%Y-%m-%dT%H:%M:%S') AS timestamp, {_KINDS} FROM judged GROUP BY 1",
        "timestamp,",
    )
    + ") z",
    "feedback findings",
)
def _(t):
    return exports.metrics_export(metrics.scores_by_period(t.feedback, t.findings, "daily", 6))


@query(
    "k11_metric_snapshot_rows",
    f"WITH {_JUDGED} SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d') AS day, language, tool, severity, "
    "'monthly' AS period, count(*) FILTER (WHERE feedback_type = 'true_positive') AS true_positives, "
    "count(*) FILTER (WHERE feedback_type = 'false_positive') AS false_positives, "
    "count(DISTINCT finding_id) AS total_findings FROM judged GROUP BY 1, 2, 3, 4",
    "feedback findings",
)
def _(t):
    rows = metrics.metric_snapshots(t.feedback, t.findings, "monthly")
    return rows.select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"),
        "language",
        "tool",
        "severity",
        "period",
        "true_positives",
        "false_positives",
        "total_findings",
    )


# --------------------------------------------------------------- feedback


@query(
    "j01_feedback_with_finding",
    "SELECT fb.id, fb.finding_id, fb.feedback_type, f.tool, f.rule_id, f.severity FROM feedback fb "
    "JOIN findings f ON fb.finding_id = f.id WHERE f.tool = 'eslint'",
    "feedback findings",
)
def _(t):
    rows = metrics.feedback_with_findings(t.feedback, metrics.filter_window(t.findings, tool="eslint"))
    return rows.select("id", "finding_id", "feedback_type", "tool", "rule_id", "severity")


_STATS = (
    "count(*) AS total_feedback, count(*) FILTER (WHERE feedback_type = 'true_positive') AS true_positives, "
    "count(*) FILTER (WHERE feedback_type = 'false_positive') AS false_positives, "
    "count(*) FILTER (WHERE feedback_type = 'false_negative') AS false_negatives, "
    "round(coalesce(CAST(count(*) FILTER (WHERE feedback_type = 'false_positive') AS DOUBLE) / nullif(count(*), 0), 0.0), 6) "
    "AS false_positive_rate"
)


@query("a09_feedback_stats", f"SELECT {_STATS} FROM feedback", "feedback")
def _(t):
    return feedback.stats(t.feedback).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query(
    "p11_feedback_filtered_stats",
    f"WITH {_JUDGED} SELECT severity, {_STATS} FROM judged WHERE created_at >= TIMESTAMP '2024-01-03 00:00:00' "
    "AND created_at <= TIMESTAMP '2024-01-25 00:00:00' AND tool = 'gosec' AND language = 'go' GROUP BY severity",
    "feedback findings",
)
def _(t):
    kept = metrics.feedback_with_findings(
        metrics.filter_window(t.feedback, datetime(2024, 1, 3), datetime(2024, 1, 25)),
        metrics.filter_window(t.findings, language="go", tool="gosec"),
    )
    return feedback.stats(kept, ["severity"]).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query(
    "a10_feedback_by_rule",
    f"WITH {_JUDGED} SELECT rule_id, count(*) AS total_feedback, "
    "count(*) FILTER (WHERE feedback_type = 'false_positive') AS false_positives, "
    "round(CAST(count(*) FILTER (WHERE feedback_type = 'false_positive') AS DOUBLE) / count(*), 6) "
    "AS false_positive_rate FROM judged GROUP BY rule_id",
    "feedback findings",
)
def _(t):
    return feedback.stats_by_rule(_judged(t)).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query(
    "p16_feedback_intake",
    "SELECT fb.id, CASE WHEN kind NOT IN ('true_positive', 'false_positive', 'false_negative') THEN "
    "'invalid feedback_type' WHEN f.id IS NULL THEN 'finding not found' ELSE 'accepted' END AS outcome FROM "
    "(SELECT event_id AS id, event_id + user_id AS finding_id, CASE event_type WHEN 'click' THEN 'true_positive' "
    "WHEN 'error' THEN 'false_positive' WHEN 'view' THEN 'false_negative' ELSE event_type END AS kind FROM events) fb "
    "LEFT JOIN (SELECT id FROM findings WHERE severity <> 'INFO') f ON fb.finding_id = f.id",
    "findings",
)
def _(t):
    incoming = t.events.selectExpr(
        "event_id AS id",
        "event_id + user_id AS finding_id",
        "CASE event_type WHEN 'click' THEN 'true_positive' WHEN 'error' THEN 'false_positive' "
        "WHEN 'view' THEN 'false_negative' ELSE event_type END AS feedback_type",
    )
    checked = feedback.check_intake(incoming, t.findings.where("severity <> 'INFO'"))
    return checked.select("id", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query(
    "t01_recent_feedback",
    "SELECT id, finding_id, user_github_username, feedback_type FROM feedback "
    "WHERE feedback_type = 'false_positive' ORDER BY created_at DESC, id DESC LIMIT 25",
    "feedback",
)
def _(t):
    return feedback.recent(t.feedback, 25, "false_positive").select(
        "id", "finding_id", "user_github_username", "feedback_type"
    )


@query(
    "t02_recent_feedback_for_rule",
    f"WITH {_JUDGED} SELECT id, finding_id, feedback_type FROM judged WHERE rule_id = 'B105' "
    "ORDER BY created_at DESC, id DESC LIMIT 10",
    "feedback findings",
)
def _(t):
    return feedback.recent_for_rule(metrics.feedback_with_findings(t.feedback, t.findings), "B105").select("id", "finding_id", "feedback_type")


@query(
    "j01_marked_false_positive",
    "SELECT f.id, f.id IN (SELECT finding_id FROM feedback WHERE feedback_type = 'false_positive') "
    "AS false_positive_marked FROM findings f",
    "feedback findings",
)
def _(t):
    return feedback.mark_false_positives(t.findings, t.feedback).select("id", "false_positive_marked")


# ------------------------------------------------------------------ rules


@query(
    "p13_list_rules",
    "SELECT id, name, language, tool, rule_id FROM existing_rules WHERE language = 'go' AND tool = 'gosec' AND enabled",
    "existing_rules",
)
def _(t):
    return rules.list_rules(t.existing_rules, "go", "gosec", True).select("id", "name", "language", "tool", "rule_id")


@query(
    "p14_rule_validation",
    "SELECT i.ord, CASE WHEN i.language NOT IN ('python', 'javascript', 'typescript', 'go', 'rust') THEN 'invalid language' "
    "WHEN i.tool NOT IN ('bandit', 'eslint', 'gosec', 'cargo-clippy', 'cargo-audit') THEN 'invalid tool' "
    "WHEN EXISTS (SELECT 1 FROM existing_rules e WHERE e.tool = i.tool AND e.rule_id = i.rule_id) THEN "
    "'Rule ' || i.tool || ':' || i.rule_id || ' already exists' ELSE 'accepted' END AS outcome FROM incoming_rules i",
    "existing_rules incoming_rules",
)
def _(t):
    checked = rules.check_new_rules(t.incoming_rules, t.existing_rules)
    return checked.select("ord", F.coalesce("reason", F.lit("accepted")).alias("outcome"))


@query(
    "p15_rule_update",
    "SELECT r.id, CASE WHEN s.s_suppkey IS NULL THEN r.enabled ELSE NOT r.enabled END AS enabled, "
    "CASE WHEN s.s_acctbal > 0 THEN NULL ELSE r.severity_override END AS severity_override, r.custom_message "
    "FROM existing_rules r LEFT JOIN supplier s ON r.id = s.s_suppkey * 2",
    "existing_rules",
)
def _(t):
    patches = (
        t.supplier.selectExpr("s_suppkey * 2 AS id", "s_acctbal")
        .join(t.existing_rules.select("id", F.col("enabled").alias("was")), "id")
        .select(
            "id",
            F.when(F.col("s_acctbal") > 0, F.array(F.lit("enabled"), F.lit("severity_override")))
            .otherwise(F.array(F.lit("enabled")))
            .alias("fields"),
            (~F.col("was")).alias("enabled"),
            F.lit(None).cast("string").alias("severity_override"),
            F.lit("ignored").alias("custom_message"),
            F.lit("ignored").alias("description"),
            F.current_timestamp().alias("updated_at"),
        )
    )
    out = rules.update_rules(t.existing_rules, patches)
    return out.select("id", "enabled", "severity_override", "custom_message")


@query(
    "p15_rule_delete",
    "SELECT id, rule_id FROM existing_rules WHERE id NOT IN (SELECT s_suppkey * 3 FROM supplier)",
    "existing_rules",
)
def _(t):
    return rules.delete_rules(t.existing_rules, t.supplier.selectExpr("s_suppkey * 3 AS id")).select("id", "rule_id")


@query(
    "p15_rule_missing_ids",
    "SELECT s_suppkey * 40 AS id FROM supplier WHERE s_suppkey * 40 NOT IN (SELECT id FROM existing_rules)",
    "existing_rules",
)
def _(t):
    return rules.missing_ids(t.existing_rules, t.supplier.selectExpr("s_suppkey * 40 AS id"))


@query(
    "t03_rule_page",
    "SELECT id, name, rule_id FROM existing_rules ORDER BY id LIMIT 50 OFFSET 30",
    "existing_rules",
)
def _(t):
    return rules.page(t.existing_rules, 30, 50).select("id", "name", "rule_id")


@query(
    "k04_rule_export",
    "SELECT name, language, tool, rule_id, enabled, severity_override, custom_message, description "
    "FROM existing_rules WHERE tool = 'eslint'",
    "existing_rules",
)
def _(t):
    return rules.export_rules(t.existing_rules, tool="eslint")


@query(
    "j10_import_rejects",
    "SELECT i.ord, 'Rule ' || i.tool || ':' || i.rule_id || ' already exists' AS error FROM incoming_rules i "
    "WHERE EXISTS (SELECT 1 FROM existing_rules e WHERE e.tool = i.tool AND e.rule_id = i.rule_id)",
    "existing_rules incoming_rules",
)
def _(t):
    return rules.check_import(t.incoming_rules, t.existing_rules).where("error IS NOT NULL").select("ord", "error")


@query(
    "u03_import_union",
    "SELECT name, language, tool, rule_id, enabled FROM existing_rules UNION ALL SELECT name, language, tool, rule_id, "
    "enabled FROM incoming_rules i WHERE NOT EXISTS (SELECT 1 FROM existing_rules e WHERE e.tool = i.tool AND "
    "e.rule_id = i.rule_id)",
    "existing_rules incoming_rules",
)
def _(t):
    out = rules.import_rules(t.incoming_rules, t.existing_rules)
    return out.select("name", "language", "tool", "rule_id", "enabled")


@query(
    "a27_import_summary",
    "WITH c AS (SELECT i.ord, 'Rule ' || i.tool || ':' || i.rule_id || ' already exists' AS error, "
    "EXISTS (SELECT 1 FROM existing_rules e WHERE e.tool = i.tool AND e.rule_id = i.rule_id) AS dup "
    "FROM incoming_rules i) SELECT (SELECT count(*) FROM c WHERE NOT dup) AS imported, "
    "(SELECT count(*) FROM c WHERE dup) AS failed, (SELECT string_agg(error, '; ' ORDER BY ord) FROM "
    "(SELECT * FROM c WHERE dup ORDER BY ord LIMIT 10)) AS errors",
    "existing_rules incoming_rules",
)
def _(t):
    out = rules.import_summary(rules.check_import(t.incoming_rules, t.existing_rules))
    return out.select("imported", "failed", F.array_join("errors", "; ").alias("errors"))


@query(
    "j09_apply_custom_rules",
    "SELECT f.id, coalesce(r.severity_override, f.severity) AS severity, coalesce(r.custom_message, f.description) "
    "AS description FROM findings f LEFT JOIN finding_rules r ON f.tool = r.tool AND f.rule_id = r.rule_id "
    "WHERE coalesce(r.enabled, TRUE)",
    "findings finding_rules",
)
def _(t):
    return rules.apply_rules(t.findings, t.finding_rules).select("id", "severity", "description")


# ------------------------------------------------------------------ costs

_PRICES = (
    "prices AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{p}', '{m}', CAST({i:.6f} AS DOUBLE), CAST({o:.6f} AS DOUBLE))" for p, m, i, o in costs.PRICES)
    + ") v(provider, model, pin, pout)), defaults AS (SELECT provider, pin, pout FROM prices WHERE model IN "
    "('gpt-4o', 'claude-3-5-sonnet-20241022', 'gemini-1.5-pro'))"
)
_PRICED = (
    f"{_PRICES}, priced AS (SELECT c.*, coalesce(p.pin, d.pin) AS pin, coalesce(p.pout, d.pout) AS pout "
    "FROM llm_calls c LEFT JOIN prices p ON c.provider = p.provider AND c.model = p.model "
    "LEFT JOIN defaults d ON c.provider = d.provider), "
    "costed AS (SELECT *, input_tokens * pin / 1000 + output_tokens * pout / 1000 AS cost_usd FROM priced)"
)


@query(
    "j12_price_lookup",
    f"WITH {_PRICED} SELECT provider, model, pin AS price_in, pout AS price_out, count(*) AS calls FROM priced "
    "GROUP BY 1, 2, 3, 4",
    "llm_calls",
)
def _(t):
    rows = costs.attach_prices(t.llm_calls)
    return rows.groupBy("provider", "model", "price_in", "price_out").agg(F.count("*").alias("calls"))


@query(
    "f20_call_cost",
    f"WITH {_PRICED} SELECT provider, model, input_tokens, output_tokens, round(cost_usd, 9) AS cost_usd FROM costed",
    "llm_calls",
)
def _(t):
    rows = costs.with_cost(t.llm_calls)
    return rows.select("provider", "model", "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "f26_cost_entries",
    f"WITH {_PRICED} SELECT strftime(timestamp, '%Y-%m') AS month, provider, model, scan_id, finding_id, "
    "input_tokens + output_tokens AS tokens, round(cost_usd, 9) AS cost_usd FROM costed",
    "llm_calls",
)
def _(t):
    rows = costs.with_cost(t.llm_calls)
    return rows.select(
        costs.month_of(F.col("timestamp")).alias("month"),
        "provider",
        "model",
        "scan_id",
        "finding_id",
        (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.round("cost_usd", 9).alias("cost_usd"),
    )


@query(
    "a11_total_cost_in_range",
    f"WITH {_PRICED} SELECT round(coalesce(sum(cost_usd), 0.0), 4) AS cost_usd, count(*) AS requests FROM costed "
    "WHERE timestamp >= TIMESTAMP '1997-03-01 00:00:00' AND timestamp <= TIMESTAMP '1998-06-30 00:00:00' "
    "AND provider = 'anthropic'",
    "llm_calls",
)
def _(t):
    kept = costs.in_range(t.llm_calls, datetime(1997, 3, 1), datetime(1998, 6, 30), "anthropic")
    out = costs.cost_by(kept, [])
    return out.select(F.round("cost_usd", 4).alias("cost_usd"), "requests")


@query(
    "a12_cost_breakdown",
    f"WITH {_PRICED}, long AS (SELECT 'total' AS scope, 'all' AS name, * FROM costed UNION ALL "
    "SELECT 'provider', provider, * FROM costed UNION ALL SELECT 'model', model, * FROM costed) "
    "SELECT scope, name, round(sum(cost_usd), 4) AS cost_usd, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, "
    "count(*) AS requests FROM long GROUP BY 1, 2",
    "llm_calls",
)
def cost_breakdown(t):
    return costs.breakdown(t.llm_calls).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    "a13_monthly_cost",
    f"WITH {_PRICED} SELECT strftime(timestamp, '%Y-%m') AS month, round(sum(cost_usd), 4) AS cost_usd, "
    "CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS requests FROM costed GROUP BY 1",
    "llm_calls",
)
def _(t):
    return costs.monthly_cost(t.llm_calls).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    "a14_budget_check",
    f"WITH {_PRICED} SELECT strftime(timestamp, '%Y-%m') AS month, round(sum(cost_usd), 4) AS cost_usd, "
    "CAST(15 AS DOUBLE) AS budget_usd, sum(cost_usd) <= 15 AS within_budget FROM costed GROUP BY 1",
    "llm_calls",
)
def _(t):
    out = costs.budget_check(costs.monthly_cost(t.llm_calls), 15.0)
    return out.withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    "f21_month_buckets",
    "SELECT strftime(timestamp, '%Y-%m') AS month, strftime(date_trunc('month', timestamp), '%Y-%m-%d') AS first_day, "
    "strftime(date_trunc('month', timestamp) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_first_day, count(*) AS n "
    "FROM llm_calls GROUP BY 1, 2, 3",
    "llm_calls",
)
def _(t):
    start, end = costs.month_bounds(F.col("timestamp"))
    return t.llm_calls.groupBy(
        costs.month_of(F.col("timestamp")).alias("month"),
        F.date_format(start, "yyyy-MM-dd").alias("first_day"),
        F.date_format(end, "yyyy-MM-dd").alias("next_first_day"),
    ).agg(F.count("*").alias("n"))


@query(
    "u02_distinct_cost_entries",
    "SELECT DISTINCT * REPLACE (strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp) FROM llm_calls",
    "llm_calls",
)
def _(t):
    """Whole entries, each of them there twice."""
    out = costs.distinct_entries(t.llm_calls.unionByName(t.llm_calls))
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query(
    "x07_cost_retention",
    "WITH last AS (SELECT strftime(timestamp, '%Y-%m') AS month, max(timestamp) AS newest FROM llm_calls GROUP BY 1) "
    "SELECT strftime(c.timestamp, '%Y-%m') AS month, count(*) AS n FROM llm_calls c JOIN last l "
    "ON strftime(c.timestamp, '%Y-%m') = l.month WHERE l.newest + INTERVAL 90 DAY >= TIMESTAMP '2000-06-01 00:00:00' GROUP BY 1",
    "llm_calls",
)
def _(t):
    kept = costs.retained(t.llm_calls, F.lit(datetime(2000, 6, 1)))
    return kept.groupBy(costs.month_of(F.col("timestamp")).alias("month")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------- compliance


def _has(words):
    tests = [f"contains(lower({c}), '{w}')" for w in words for c in ("rule_id", "description")]
    return "(" + " OR ".join(tests) + ")"


_SOC2 = {c: _has(w) for c, w in compliance.SOC2.categories.items()}
_GDPR = {c: _has(w) for c, w in compliance.GDPR.categories.items()}
_HIPAA = {c: _has(w) for c, w in compliance.HIPAA.categories.items()}


def _counts(cats):
    return ", ".join(f"count(*) FILTER (WHERE {cond}) AS {c}_findings" for c, cond in cats.items())


def _pass(cats):
    return ", ".join(f"CASE WHEN {c}_findings = 0 THEN 'PASS' ELSE 'FAIL' END AS {c}_status" for c in cats)


def _advice(cats, std):
    arms = [
        f"CASE WHEN {c}_findings > 0 THEN '{'|'.join(x for x in texts)}|' ELSE '' END"
        for c, texts in std.recommendations.items()
    ]
    return f"rtrim({' || '.join(arms)}, '|') AS recommendations"


@query(
    "a16_soc2_report",
    f"SELECT scan_job_id, total_findings, critical_findings, high_findings, security_findings, confidentiality_findings, "
    f"privacy_findings, {_pass(_SOC2)}, greatest(0, 100 - critical_findings * 10 - high_findings * 5) AS compliance_score, "
    "CASE WHEN greatest(0, 100 - critical_findings * 10 - high_findings * 5) >= 80 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' "
    f"END AS status, {_advice(_SOC2, compliance.SOC2)} FROM (SELECT scan_job_id, count(*) AS total_findings, "
    "count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_findings, count(*) FILTER (WHERE severity = 'HIGH') "
    f"AS high_findings, {_counts(_SOC2)} FROM findings GROUP BY scan_job_id) s",
    "findings",
)
def soc2(t):
    out = compliance.summary(t.findings, "soc2", "scan_job_id")
    return out.select(
        "scan_job_id",
        "total_findings",
        "critical_findings",
        "high_findings",
        *[f"{c}_findings" for c in _SOC2],
        *[f"{c}_status" for c in _SOC2],
        "compliance_score",
        "status",
        F.array_join("recommendations", "|").alias("recommendations"),
    )


@query(
    "a17_gdpr_report",
    f"SELECT scan_job_id, pii_findings, encryption_findings, access_control_findings, {_pass(_GDPR)}, "
    "greatest(0, 100 - severe * 15) AS compliance_score, CASE WHEN greatest(0, 100 - severe * 15) >= 85 THEN 'COMPLIANT' "
    f"ELSE 'NON_COMPLIANT' END AS status, {_advice(_GDPR, compliance.GDPR)} FROM (SELECT scan_job_id, "
    f"count(*) FILTER (WHERE {_GDPR['pii']} AND severity IN ('CRITICAL', 'HIGH')) AS severe, {_counts(_GDPR)} "
    "FROM findings GROUP BY scan_job_id) s",
    "findings",
)
def _(t):
    out = compliance.summary(t.findings, "gdpr", "scan_job_id")
    return out.select(
        "scan_job_id",
        *[f"{c}_findings" for c in _GDPR],
        *[f"{c}_status" for c in _GDPR],
        "compliance_score",
        "status",
        F.array_join("recommendations", "|").alias("recommendations"),
    )


@query(
    "a18_hipaa_report",
    f"SELECT scan_job_id, phi_findings, encryption_findings, audit_findings, {_pass(_HIPAA)}, "
    "CASE WHEN auth_rules = 0 THEN 'PASS' ELSE 'FAIL' END AS access_control_status, "
    "greatest(0, 100 - phi_findings * 20) AS compliance_score, CASE WHEN greatest(0, 100 - phi_findings * 20) >= 90 "
    f"THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status, {_advice(_HIPAA, compliance.HIPAA)} FROM (SELECT scan_job_id, "
    f"count(*) FILTER (WHERE contains(lower(rule_id), 'auth')) AS auth_rules, {_counts(_HIPAA)} "
    "FROM findings GROUP BY scan_job_id) s",
    "findings",
)
def _(t):
    out = compliance.summary(t.findings, "HIPAA", "scan_job_id")
    return out.select(
        "scan_job_id",
        *[f"{c}_findings" for c in _HIPAA],
        *[f"{c}_status" for c in _HIPAA],
        "access_control_status",
        "compliance_score",
        "status",
        F.array_join("recommendations", "|").alias("recommendations"),
    )


@query(
    "a19_report_choice",
    "SELECT report_type, status, count(*) AS projects FROM ("
    "SELECT 'SOC2' AS report_type, CASE WHEN 100 - 10 * count(*) FILTER (WHERE severity = 'CRITICAL') - 5 * count(*) FILTER (WHERE severity = 'HIGH') >= 80 "
    "THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS status FROM findings GROUP BY scan_job_id UNION ALL "
    f"SELECT 'GDPR', CASE WHEN 100 - 15 * count(*) FILTER (WHERE {_GDPR['pii']} AND severity IN ('CRITICAL', 'HIGH')) >= 85 THEN 'COMPLIANT' ELSE "
    "'NON_COMPLIANT' END FROM findings GROUP BY scan_job_id UNION ALL "
    f"SELECT 'HIPAA', CASE WHEN 100 - 20 * count(*) FILTER (WHERE {_HIPAA['phi']}) >= 90 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END FROM findings "
    "GROUP BY scan_job_id) z GROUP BY 1, 2",
    "findings",
)
def _(t):
    parts = [compliance.summary(t.findings, kind, "scan_job_id").select("report_type", "status") for kind in ("soc2", "Gdpr", "HIPAA")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("report_type", "status").agg(F.count("*").alias("projects"))


@query(
    "a06_metrics_last_days",
    f"WITH {_JUDGED} "
    + _scores(
        f"SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, {_KINDS} FROM judged WHERE created_at >= TIMESTAMP '2024-01-13 00:00:00' "
        "AND created_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1",
        "day,",
    ),
    "feedback findings",
)
def _(t):
    out = metrics.scores_by_period(t.feedback, t.findings, "daily", 6, days=7, now=datetime(2024, 1, 20))
    return out.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), *_SCORE_COLS)


@query(
    "t05_top_compliance_findings",
    "WITH long AS ("
    + " UNION ALL ".join(
        f"SELECT language, '{c}' AS category_name, id FROM findings WHERE {cond}" for c, cond in _SOC2.items()
    )
    + ") SELECT language, category_name, id, position FROM (SELECT *, row_number() OVER (PARTITION BY language, "
    "category_name ORDER BY id) AS position FROM long) z WHERE position <= 10",
    "findings",
)
def _(t):
    out = compliance.listed_findings(t.findings, "SOC2", "language", ["id"])
    return out.select("language", "category_name", "id", F.col("position").cast("long").alias("position"))


# --------------------------------------------------- operational metrics


@query(
    "a21_counter_scans",
    "SELECT language, status, count(*) AS total FROM metric_samples GROUP BY 1, 2",
    "metric_samples",
)
def _(t):
    return metrics.counter(t.metric_samples, ["language", "status"])


@query(
    "a21_counter_requests",
    "SELECT provider, model, status, count(*) AS total FROM metric_samples GROUP BY 1, 2, 3",
    "metric_samples",
)
def _(t):
    return metrics.counter(t.metric_samples, ["provider", "model", "status"])


@query(
    "a21_counter_tokens",
    "SELECT provider, model, type, CAST(sum(n) AS BIGINT) AS total FROM (SELECT provider, model, 'input' AS type, "
    "input_tokens AS n FROM llm_calls UNION ALL SELECT provider, model, 'output', output_tokens FROM llm_calls) z "
    "GROUP BY 1, 2, 3",
    "llm_calls",
)
def _(t):
    long = t.llm_calls.unpivot(
        ["provider", "model"],
        ["input_tokens", "output_tokens"],
        "type",
        "n",
    ).withColumn("type", F.replace("type", F.lit("_tokens"), F.lit("")))
    return metrics.counter(long, ["provider", "model", "type"], F.col("n"))


@query(
    "a21_counter_findings",
    "SELECT severity, language, tool, count(*) AS total FROM findings GROUP BY 1, 2, 3",
    "findings",
)
def _(t):
    return metrics.counter(t.findings, ["severity", "language", "tool"])


@query(
    "a22_dashboard_by_severity_and_language",
    "SELECT 'severity' AS panel, severity AS label, count(*) AS total FROM findings GROUP BY 2 UNION ALL "
    "SELECT 'language', language, count(*) FROM findings GROUP BY 2 UNION ALL "
    "SELECT 'all', 'all', count(*) FROM findings",
    "findings",
)
def _(t):
    sets = t.findings.groupingSets([[], ["severity"], ["language"]], "severity", "language")
    return sets.agg(F.grouping_id().alias("g"), F.count("*").alias("total")).select(
        F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "language").otherwise("all").alias("panel"),
        F.coalesce("severity", "language", F.lit("all")).alias("label"),
        "total",
    )


@query(
    "a21_counter_cost",
    f"WITH {_PRICED} SELECT provider, model, round(sum(cost_usd), 4) AS total FROM costed GROUP BY 1, 2",
    "llm_calls",
)
def _(t):
    out = costs.cost_by(t.llm_calls, ["provider", "model"])
    return out.select("provider", "model", F.round("cost_usd", 4).alias("total"))


_LOOKED = (
    "ent AS (SELECT 'user' || CAST(user_id AS VARCHAR) AS key, ts AS cached_at FROM events WHERE event_type = 'purchase'), "
    "look AS (SELECT r.request_id, coalesce(r.ts < e.cached_at + INTERVAL 86400 SECOND, FALSE) AS hit FROM requests r ASOF LEFT JOIN ent e "
    "ON r.key = e.key AND r.ts >= e.cached_at)"
)


def _looked_up(t):
    entries = t.events.where("event_type = 'purchase'").selectExpr(
        "'user' || CAST(user_id AS STRING) AS key", "CAST(event_id AS STRING) AS payload", "CAST(ts AS TIMESTAMP) AS cached_at", "CAST(86400 AS BIGINT) AS ttl_s"
    )
    return cache.lookup(t.requests, entries)


@query(
    "a21_counter_cache",
    f"WITH {_LOOKED} SELECT CASE WHEN hit THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS total FROM look GROUP BY 1",
    "requests",
)
def _(t):
    looked = _looked_up(t).withColumn("outcome", F.when(F.col("hit"), "hit").otherwise("miss"))
    return metrics.counter(looked, ["outcome"])


@query(
    "a22_dashboard_totals",
    f"WITH {_PRICED}, {_LOOKED} SELECT 'scans' AS panel, CAST(count(*) AS DOUBLE) AS total FROM scan_jobs UNION ALL SELECT 'cost_usd', round(sum(cost_usd), 4) FROM costed UNION ALL "
    "SELECT 'cache_hit_rate', round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 6) FROM look",
    "llm_calls requests scan_jobs",
)
def _(t):
    scans = t.scan_jobs.agg(F.count("*").cast("double").alias("total"))
    cost = costs.cost_by(t.llm_calls, []).select(F.round("cost_usd", 4).alias("total"))
    rate = _looked_up(t).agg(F.round(F.count_if("hit") / F.count("*"), 6).alias("total"))
    parts = [p.select(F.lit(name).alias("panel"), "total") for name, p in (("scans", scans), ("cost_usd", cost), ("cache_hit_rate", rate))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "a23_token_rate",
    "SELECT strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS window_start, provider, kind, "
    "CAST(sum(amount) AS BIGINT) AS total, round(CAST(sum(amount) AS DOUBLE) / 300, 6) AS per_second "
    "FROM metric_samples GROUP BY 1, 2, 3",
    "metric_samples",
)
def _(t):
    out = metrics.rate_per_second(t.metric_samples, ["provider", "kind"], F.col("amount"))
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "provider",
        "kind",
        "total",
        F.round("per_second", 6).alias("per_second"),
    )


def _quantile_sql(label: str, seconds: int) -> str:
    bounds = ", ".join(f"({i}, CAST({b} AS DOUBLE))" for i, b in enumerate(metrics.LATENCY_BUCKETS))
    return (
        f"WITH bounds AS (SELECT * FROM (VALUES {bounds}) v(i, hi)), "
        f"s AS (SELECT floor(epoch(ts) / {seconds}) * {seconds} AS w, {label}, duration FROM metric_samples), "
        f"cum AS (SELECT s.w, s.{label}, b.i, b.hi, count(*) FILTER (WHERE s.duration <= b.hi) AS le, count(*) AS n "
        f"FROM s CROSS JOIN bounds b GROUP BY 1, 2, 3, 4), "
        f"lagged AS (SELECT *, lag(le, 1, 0) OVER (PARTITION BY w, {label} ORDER BY i) AS below, "
        f"lag(hi, 1, 0.0) OVER (PARTITION BY w, {label} ORDER BY i) AS lo FROM cum), "
        f"first AS (SELECT w, {label}, min(i) FILTER (WHERE le >= n * 0.95) AS i FROM lagged GROUP BY 1, 2) "
        f"SELECT strftime(to_timestamp(f.w) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS window_start, f.{label}, "
        f"round(coalesce(l.lo + (l.hi - l.lo) * (l.n * 0.95 - l.below) / (l.le - l.below), 10.0), 6) AS p95 "
        f"FROM first f LEFT JOIN lagged l ON f.w = l.w AND f.{label} = l.{label} AND f.i = l.i"
    )


for _label, _seconds in (("language", 300), ("provider", 300)):

    @query(f"a20_p95_duration_by_{_label}", _quantile_sql(_label, _seconds), "metric_samples")
    def _(t, label=_label, seconds=_seconds):
        out = metrics.histogram_quantile(t.metric_samples, 0.95, [label], "duration", seconds=seconds)
        return out.select(
            F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
            label,
            F.round("quantile", 6).alias("p95"),
        )


@query(
    "a20_p95_duration_exact",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, language, count(duration) AS n, round(quantile_cont(CAST(duration AS DOUBLE), 0.95), 6) AS p95 "
    "FROM metric_samples WHERE duration IS NOT NULL GROUP BY 1, 2",
    "metric_samples",
)
def _(t):
    out = metrics.exact_quantile(t.metric_samples, 0.95, ["language"], "duration")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "language", "n", F.round("quantile", 6).alias("p95"))


@query(
    "a20_p95_duration_sketched",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, language, count(duration) AS n, TRUE AS within_bound "
    "FROM metric_samples WHERE duration IS NOT NULL GROUP BY 1, 2",
    "metric_samples",
)
def _(t):
    """Five-minute sketches merged to days; the share of the rows below each answer is within a hundredth of 0.95."""
    merged = metrics.merge_sketches(metrics.quantile_sketches(t.metric_samples, ["language"], "duration"), ["language"], "day")
    answers = metrics.sketched_quantile(merged, 0.95).withColumnRenamed("n", "of")
    rows = t.metric_samples.where("duration IS NOT NULL").withColumn("window_start", F.date_trunc("day", F.col("ts").cast("timestamp")))
    ranked = rows.join(answers, ["window_start", "language"]).groupBy("window_start", "language", "of").agg(
        F.count("*").alias("n"), F.count_if(F.col("duration") < F.col("quantile")).alias("below"), F.count_if(F.col("duration") <= F.col("quantile")).alias("upto")
    )
    within = (F.col("below") <= 0.96 * F.col("n")) & (F.col("upto") >= 0.94 * F.col("n")) & (F.col("of") == F.col("n"))
    return ranked.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "language", "n", within.alias("within_bound"))


@query(
    "w03_active_scans",
    "WITH marks AS (SELECT event_id AS order_id, ts, user_id % 5 AS lane, CASE WHEN event_type IN ('click', 'signup') "
    "THEN 1 WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 0 END AS delta FROM events) "
    "SELECT order_id, lane, CAST(sum(delta) OVER (PARTITION BY lane ORDER BY ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW) AS BIGINT) AS active FROM marks",
)
def _(t):
    marks = t.events.selectExpr(
        "event_id AS order_id",
        "ts",
        "user_id % 5 AS lane",
        "CASE WHEN event_type IN ('click', 'signup') THEN 1 WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 0 END "
        "AS delta",
    )
    return metrics.active_gauge(marks, keys=["lane"]).select("order_id", "lane", "active")


# ------------------------------------------------------------ own tables


@query(
    "s19_typed_tables",
    "SELECT id, scan_job_id, tool, line_number, CAST(NULL AS VARCHAR) AS cve, strftime(created_at, '%Y-%m-%d') AS day FROM findings",
    "findings",
)
def _(t):
    rows = tables.conform(t.findings, "findings")
    return rows.select("id", "scan_job_id", "tool", "line_number", "cve", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    "s20_rule_lists",
    "SELECT CAST(ord AS VARCHAR) AS batch_id, CAST(0 AS BIGINT) AS ord, name, language, tool, rule_id, CASE WHEN ord % 3 = 0 THEN TRUE ELSE enabled END AS enabled, "
    "severity_override FROM incoming_rules",
    "incoming_rules",
)
def _(t):
    fields = [c for c in rules.EXPORT_COLUMNS if c != "enabled"]
    rule = F.struct(*fields, F.when(F.col("ord") % 3 != 0, F.col("enabled")).alias("enabled"))
    batches = t.incoming_rules.select(F.col("ord").cast("string").alias("batch_id"), F.to_json(F.array(rule)).alias("content"))
    out = tables.parse_rule_lists(batches)
    return out.select("batch_id", "ord", "name", "language", "tool", "rule_id", "enabled", "severity_override")


@query(
    "k10_audit_events",
    "SELECT 'scan_started' AS event_type, repo AS repo_full_name, number AS pr_number, '{\"sha\":\"' || sha || '\",\"event\":\"' || event || '\"}' AS details, "
    "strftime(received_at, '%Y-%m-%d') AS day FROM deliveries",
    "deliveries",
)
def _(t):
    rows = t.deliveries.withColumnRenamed("repo", "repo_full_name").withColumnRenamed("number", "pr_number")
    out = tables.audit_events(rows, "scan_started", "received_at", ["sha", "event"])
    return out.select(
        "event_type", "repo_full_name", "pr_number", "details", F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    )


@query(
    "k12_results_by_language",
    "SELECT id, rule_id, line_number, language FROM findings",
    "findings",
)
def _(t):
    """Scan results written as JSON per language and read back."""
    path = work_dir(t.spark, "results")
    exports.write_scan_results(t.findings, path)
    back = t.spark.read.schema("id long, rule_id string, line_number int, language string").json(path)
    return back.select("id", "rule_id", "line_number", "language")
