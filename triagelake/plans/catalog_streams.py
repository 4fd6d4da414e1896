"""Streaming queries: each runs over all input present and must equal its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.plans.catalog_findings import _url
from triagelake.plans.catalog_source import SECRET, deliveries
from triagelake.plans.proxies import RAW_DDL, Tables
from triagelake.plans.registry import query
from triagelake.session import work_dir
from triagelake.sinks import documents as doc
from triagelake.sources import deliveries as dv
from triagelake.sources import reports as rp
from triagelake.streaming import streams


class StreamTables(Tables):
    """The same tables and views, read as streams."""

    def raw(self, name: str):
        schema = T.StructType.fromDDL(RAW_DDL[name])
        return streams.read_table_stream(self.spark, self.sf_dir, f"{name}.parquet", schema)


def _live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


def _instant(df, column: str = "ts"):
    return df.withColumn(column, F.col(column).cast("timestamp"))


_QUEUED = (
    "SELECT delivery_id, event, repo AS repo_full_name, CASE event WHEN 'pull_request' THEN number ELSE 0 END AS pr_number, sha AS commit_sha FROM deliveries "
    "WHERE (event = 'pull_request' AND action IN ('opened', 'synchronize')) OR (event = 'push' AND ref IN ('refs/heads/main', 'refs/heads/master'))"
)


@query("x01_delivery_queue_stream", _QUEUED, "deliveries")
def _(t):
    queue = dv.scan_queue(_instant(deliveries(_live(t)), "received_at"), SECRET)
    rows = streams.run_available(queue, "x01")
    return rows.select(
        "delivery_id", "event", "repo_full_name", F.coalesce("pr_number", F.lit(0)).alias("pr_number"), "commit_sha"
    )


_FLOOR = "strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M')"


@query(
    "x02_tumbling_totals_stream",
    f"SELECT {_FLOOR} AS window_start, provider, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM metric_samples GROUP BY 1, 2",
    "metric_samples",
)
def _(t):
    totals = streams.tumbling_totals(_instant(_live(t).metric_samples), ["provider"], F.col("amount"))
    rows = streams.run_available(totals, "x02", "update", ["window_start", "provider"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "x03_sliding_totals_stream",
    "SELECT strftime(to_timestamp(w * 30) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, provider, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM "
    "(SELECT provider, amount, unnest(range(CAST(floor(epoch(ts) / 30) AS BIGINT) - 9, CAST(floor(epoch(ts) / 30) AS BIGINT) + 1)) AS w FROM metric_samples) z GROUP BY 1, 2",
    "metric_samples",
)
def _(t):
    totals = streams.tumbling_totals(
        _instant(_live(t).metric_samples), ["provider"], F.col("amount"), slide="30 seconds"
    )
    rows = streams.run_available(totals, "x03", "update", ["window_start", "provider"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


#: The requests as two arrivals: every seventh comes when all others have been answered.
_ARRIVED = (
    "r AS (SELECT event_id AS request_id, 'user' || CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 = 0, ts, event_id) AS n, "
    "max(epoch_us(ts)) FILTER (event_id % 7 <> 0) OVER (PARTITION BY user_id) AS answered, event_id % 7 = 0 AS second FROM events), "
    "a AS (SELECT request_id, key, us, n, coalesce(second AND us < answered, FALSE) AS late, max(us) OVER (PARTITION BY key ORDER BY n) AS moment FROM r), "
)


def _arrivals(t):
    """The requests written as two files, read one a batch: many of the second are older than answered ones."""
    folder = work_dir(t.spark, "arrivals")
    for second in (False, True):
        rows = t.requests.where((F.col("request_id") % 7 == 0) == second)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/arrival={int(second)}")
    stream = t.spark.readStream.schema(t.requests.schema).option("maxFilesPerTrigger", 1)
    return stream.option("recursiveFileLookup", True).parquet(folder)


@query(
    "x04_ttl_cache_stream",
    f"WITH RECURSIVE {_ARRIVED}walk AS (SELECT request_id, key, n, FALSE AS hit, late, us AS written FROM a WHERE n = 1 UNION ALL "
    "SELECT a.request_id, a.key, a.n, a.us < w.written + 86400000000, a.late, CASE WHEN a.us < w.written + 86400000000 THEN w.written ELSE a.us END "
    "FROM walk w JOIN a ON a.key = w.key AND a.n = w.n + 1) SELECT request_id, key, hit, late FROM walk",
)
def _(t):
    return streams.run_available(streams.ttl_cache_stream(_arrivals(t), 86400), "x04", idle_batches=False)


_LEVEL = "least(3.0, w.allowance + (a.moment - w.moment) / 1000000.0 * 3.0 / 86400.0)"


@query(
    "x05_token_bucket_stream",
    f"WITH RECURSIVE {_ARRIVED}walk AS (SELECT request_id, key, moment, n, TRUE AS admitted, late, CAST(2 AS DOUBLE) AS allowance FROM a WHERE n = 1 UNION ALL "
    f"SELECT a.request_id, a.key, a.moment, a.n, {_LEVEL} >= 1.0, a.late, CASE WHEN {_LEVEL} >= 1.0 THEN {_LEVEL} - 1.0 ELSE {_LEVEL} END "
    "FROM walk w JOIN a ON a.key = w.key AND a.n = w.n + 1) SELECT request_id, key, admitted, late FROM walk",
)
def _(t):
    return streams.run_available(streams.token_bucket_stream(_arrivals(t), 3, 86400), "x05", idle_batches=False)


@query(
    "x06_monthly_spend_stream",
    "SELECT strftime(timestamp, '%Y-%m') AS month, CAST(sum(input_tokens * 3 + output_tokens * 15) AS BIGINT) AS cost_micros, sum(input_tokens * 3 + output_tokens * 15) > 5000000 AS over_budget "
    "FROM llm_calls GROUP BY 1",
    "llm_calls",
)
def _(t):
    entries = _live(t).llm_calls.select("timestamp", F.expr("input_tokens * 3 + output_tokens * 15").alias("cost_micros"))
    return streams.run_available(streams.monthly_spend(entries, 5.0), "x06", "update", ["month"])


@query(
    "x08_alert_stream",
    "SELECT id, '*Line:*' || chr(10) || CAST(line_number AS VARCHAR) AS line FROM findings WHERE severity IN ('CRITICAL', 'HIGH')",
    "findings",
)
def _(t):
    rows = streams.run_available(doc.notifications(_live(t).findings, _url(), "slack"), "x08")
    return rows.select("id", F.get_json_object("payload", "$.blocks[1].fields[3].text").alias("line"))


@query(
    "x09_report_file_stream",
    "SELECT rule_id, count(*) AS n FROM findings WHERE tool = 'bandit' GROUP BY 1",
    "findings",
)
def _(t):
    """Report files written from the findings, picked up by the stream."""
    folder = work_dir(t.spark, "reports")
    issue = F.struct(F.struct(F.col("rule_id").alias("test_id")).alias("r"))
    lines = t.findings.where("tool = 'bandit'").select(F.to_json(F.struct(F.array(issue["r"]).alias("results"))).alias("value"))
    lines.write.text(folder)
    stream = t.spark.readStream.text(folder).select(
        F.lit("r").alias("report_id"), F.col("value").alias("content"), F.lit(None).cast("string").alias("file_path")
    )
    found = streams.run_available(rp.parse_bandit(stream), "x09")
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "x10_active_scans_stream",
    "SELECT language, CAST(sum(CASE WHEN kind IN ('click', 'signup') THEN 1 WHEN kind IN ('error', 'purchase') THEN -1 ELSE 0 END) AS BIGINT) AS active FROM metric_samples GROUP BY 1",
    "metric_samples",
)
def _(t):
    marks = _live(t).metric_samples.selectExpr(
        "language",
        "CASE WHEN kind IN ('click', 'signup') THEN 1 WHEN kind IN ('error', 'purchase') THEN -1 ELSE 0 END AS delta",
    )
    return streams.run_available(streams.live_gauge(marks, ["language"]), "x10", "update", ["language"])
