"""Filters, joins, windows, sets, reports and messages on findings: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import languages, severity as sev
from triagelake.operators import findings as fo
from triagelake.operators.ordered import running_number
from triagelake.plans.registry import query
from triagelake.sinks import documents as doc


def _ids(column: str = "id", size: int = 4096):
    return F.floor(F.col(column) / size)


# -------------------------------------------------- maps, ranks and gates

_RAW_SEVERITY = "CASE o_orderkey % 8 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'moderate' WHEN 3 THEN 'MEDIUM' " \
    "WHEN 4 THEN 'info' WHEN 5 THEN 'low' WHEN 6 THEN 'odd' ELSE NULL END"


@query(
    "p02_dependency_severity",
    f"SELECT o_orderkey AS id, CASE WHEN upper(s) IN ('CRITICAL', 'HIGH') THEN 'HIGH' WHEN upper(s) IN ('MEDIUM', 'MODERATE') THEN "
    f"'MEDIUM' WHEN upper(s) IN ('LOW', 'INFO') THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM (SELECT *, {_RAW_SEVERITY} AS s FROM orders) o",
)
def _(t):
    rows = t.orders.selectExpr("o_orderkey AS id", f"{_RAW_SEVERITY} AS s")
    return rows.select("id", sev.dependency_severity(F.col("s")).alias("severity"))


@query(
    "p03_sarif_level",
    "SELECT id, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN "
    "'note' ELSE 'warning' END AS level FROM findings",
    "findings",
)
def _(t):
    return t.findings.select("id", sev.sarif_level(F.lower("severity")).alias("level"))


for _threshold, _set in (("critical", "'CRITICAL'"), ("medium", "'CRITICAL', 'HIGH', 'MEDIUM'"), ("unheard", "'CRITICAL'")):

    @query(
        f"p04_exit_code_{_threshold}",
        f"SELECT scan_job_id, max(CASE WHEN severity IN ({_set}) THEN 1 ELSE 0 END) AS exit_code FROM findings GROUP BY 1",
        "findings",
    )
    def _(t, threshold=_threshold):
        return sev.exit_code(t.findings, threshold, ["scan_job_id"])


@query(
    "p05_notify_filter",
    "SELECT id, severity FROM findings WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'INFO')",
    "findings",
)
def _(t):
    return t.findings.where(sev.should_notify(F.col("severity"), "MEDIUM")).select("id", "severity")


_EXT = "CASE id % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.jsx' WHEN 3 THEN '.ts' WHEN 4 THEN '.tsx' WHEN 5 THEN '.go' " \
    "WHEN 6 THEN '.rs' WHEN 7 THEN '.java' WHEN 8 THEN '.hpp' WHEN 9 THEN '.rb' WHEN 10 THEN '.php' WHEN 11 THEN '' ELSE '.c' END"


def _arms(table: dict, default: str) -> str:
    return "CASE lower(ext) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


@query(
    "p06_detect_language",
    f"SELECT id, {_arms(languages.SCANNER_EXTENSIONS, 'NULL')} AS scanner_language, {_arms(languages.CONTEXT_EXTENSIONS, 'NULL')} "
    f"AS context_language, {_arms(languages.FIX_EXTENSIONS, chr(39) + 'unknown' + chr(39))} AS fix_language FROM (SELECT id, {_EXT} AS ext FROM findings) f",
    "findings",
)
def _(t):
    rows = t.findings.selectExpr("id", f"'src.d/file' || CAST(id AS STRING) || {_EXT} AS path")
    path = F.col("path")
    return rows.select(
        "id",
        languages.scanner_language(path).alias("scanner_language"),
        languages.context_language(path).alias("context_language"),
        languages.fix_language(path).alias("fix_language"),
    )


@query(
    "p07_select_languages",
    "SELECT id, language FROM findings WHERE language IN ('go', 'rust')",
    "findings",
)
def _(t):
    return languages.select_languages(t.findings, ["Go", "rust"]).select("id", "language")


@query(
    "p08_extension_filter",
    "SELECT id, file_path FROM findings WHERE ends_with(file_path, '.py') OR ends_with(file_path, '.tsx')",
    "findings",
)
def _(t):
    return t.findings.where(languages.with_extensions(F.col("file_path"), [".py", ".tsx"])).select("id", "file_path")


@query("p09_true_positives", "SELECT id FROM findings WHERE llm_decision = 'true_positive'", "findings")
def _(t):
    return fo.true_positives(t.findings).select("id")


@query(
    "f22_markers",
    "SELECT id, CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' WHEN 'LOW' THEN '🟢' ELSE '⚠️' END "
    "AS marker, CASE severity WHEN 'CRITICAL' THEN 16711680 WHEN 'HIGH' THEN 16737792 WHEN 'MEDIUM' THEN 16776960 WHEN 'LOW' THEN 65280 "
    "ELSE 16776960 END AS color, CASE llm_decision WHEN 'true_positive' THEN '🚨' WHEN 'false_positive' THEN '✅' ELSE '⚠️' END AS decision "
    "FROM findings",
    "findings",
)
def _(t):
    return t.findings.select(
        "id",
        sev.severity_marker(F.col("severity")).alias("marker"),
        sev.embed_color(F.col("severity")).alias("color"),
        sev.decision_marker(F.col("llm_decision")).alias("decision"),
    )


# ------------------------------------------------------------------ joins


@query(
    "j02_findings_with_job",
    "SELECT f.id, j.repo_full_name, j.pr_number FROM findings f JOIN scan_jobs j ON f.scan_job_id = j.id",
    "findings scan_jobs",
)
def _(t):
    return fo.with_job(t.findings, t.scan_jobs).select("id", "repo_full_name", "pr_number")


@query(
    "j02_cascade_delete",
    "SELECT id FROM findings WHERE scan_job_id NOT IN (SELECT id FROM scan_jobs WHERE status = 'failed')",
    "findings scan_jobs",
)
def _(t):
    return fo.cascade_delete(t.findings, t.scan_jobs.where("status = 'failed'")).select("id")


_PR = (
    "pr AS (SELECT c_custkey AS scan_job_id, 'mod' || CAST(c_custkey % 7 AS VARCHAR) || '/f' || CAST(c_custkey % 5 AS VARCHAR) "
    "AS file_name FROM customer UNION ALL SELECT c_custkey, 'f1' || CAST(c_custkey % 10 AS VARCHAR) || '.' FROM customer)"
)


def _pr_files(t):
    first = t.customer.selectExpr(
        "c_custkey AS scan_job_id",
        "'mod' || CAST(c_custkey % 7 AS STRING) || '/f' || CAST(c_custkey % 5 AS STRING) AS file_name",
    )
    second = t.customer.selectExpr("c_custkey AS scan_job_id", "'f1' || CAST(c_custkey % 10 AS STRING) || '.' AS file_name")
    return first.unionByName(second)


@query(
    "j03_findings_in_pr_files",
    f"WITH {_PR} SELECT f.id, f.file_path FROM findings f WHERE EXISTS (SELECT 1 FROM pr WHERE pr.scan_job_id = f.scan_job_id "
    "AND contains(f.file_path, pr.file_name))",
    "findings",
)
def pr_findings(t):
    return fo.in_pr_files(t.findings, _pr_files(t)).select("id", "file_path")


@query(
    "j13_findings_with_verification",
    "SELECT f.id, v.decision FROM findings f LEFT JOIN (SELECT event_id AS finding_id, CASE event_type WHEN 'error' THEN 'uncertain' "
    "ELSE 'true_positive' END AS decision FROM events) v ON f.id = v.finding_id",
    "findings",
)
def _(t):
    verdicts = t.events.selectExpr(
        "event_id AS finding_id", "CASE event_type WHEN 'error' THEN 'uncertain' ELSE 'true_positive' END AS decision"
    )
    return fo.with_verification(t.findings, verdicts).select("id", "decision")


# ---------------------------------------------- windows, limits and sets


@query(
    "w01_first_ten_per_job",
    "SELECT id, scan_job_id, rn FROM (SELECT id, scan_job_id, row_number() OVER (PARTITION BY scan_job_id ORDER BY id) AS rn "
    "FROM findings) z WHERE rn <= 10",
    "findings",
)
def _(t):
    out = fo.first_per_job(t.findings, ["id"])
    return out.select("id", "scan_job_id", F.col("rn").cast("long").alias("rn"))


@query(
    "w02_running_number",
    "SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY id) AS number FROM findings",
    "findings",
)
def running_numbers(t):
    return running_number(t.findings, ["language"], ["id"], _ids(), "number").select("id", "language", "number")


@query("t04_capped_findings", "SELECT id, rule_id FROM findings ORDER BY id LIMIT 100", "findings")
def _(t):
    return fo.cap(t.findings, 100, ["id"]).select("id", "rule_id")


@query(
    "t06_first_errors",
    "SELECT ord, rule_id FROM incoming_rules WHERE tool = 'lint' ORDER BY ord LIMIT 10",
    "incoming_rules",
)
def _(t):
    return fo.cap(t.incoming_rules.where("tool = 'lint'"), 10, ["ord"]).select("ord", "rule_id")


@query(
    "u01_union_all_tools",
    "SELECT part, tool, count(*) AS n, count(extra) AS extras FROM (SELECT 0 AS part, tool, NULL AS extra FROM findings WHERE tool = 'bandit' "
    "UNION ALL SELECT 1, tool, id FROM findings WHERE tool <> 'bandit') z GROUP BY 1, 2",
    "findings",
)
def _(t):
    first = t.findings.where("tool = 'bandit'").select("id", "tool")
    second = t.findings.where("tool <> 'bandit'").select("id", "tool", F.col("id").alias("extra"))
    return fo.union_all([first, second]).groupBy("part", "tool").agg(F.count("*").alias("n"), F.count("extra").alias("extras"))


_PROJECT = "'app/' || source || '/' || CASE lang WHEN 'en' THEN 'requirements.txt' WHEN 'fr' THEN 'package.json' WHEN 'de' THEN 'go.mod' ELSE 'notes.txt' END"


@query(
    "u01_dependency_tools",
    "SELECT DISTINCT 'app/' || source AS project, CASE lang WHEN 'en' THEN 'pip-audit' WHEN 'fr' THEN 'npm-audit' ELSE 'govulncheck' END AS tool "
    "FROM documents WHERE lang IN ('en', 'fr', 'de')",
)
def _(t):
    return fo.dependency_tools(t.documents.selectExpr(f"{_PROJECT} AS path"))


@query(
    "a24_findings_per_language",
    "SELECT language, count(*) AS total FROM findings GROUP BY 1",
    "findings",
)
def _(t):
    return t.findings.groupBy("language").agg(F.count("*").alias("total"))


@query(
    "a24_scan_funnel",
    f"WITH {_PR} SELECT language, count(*) AS total, count(*) FILTER (WHERE hit) AS in_pr_files, count(*) FILTER (WHERE hit AND "
    "llm_decision = 'true_positive') AS verified FROM (SELECT f.*, EXISTS (SELECT 1 FROM pr WHERE pr.scan_job_id = f.scan_job_id AND "
    "contains(f.file_path, pr.file_name)) AS hit FROM findings f) z GROUP BY 1",
    "findings",
)
def _(t):
    found = t.findings
    hit = fo.in_pr_files(found, _pr_files(t)).select("id", F.lit(True).alias("in_pr"))
    return fo.funnel(found.join(hit, "id", "left").withColumn("in_pr", F.coalesce("in_pr", F.lit(False))), ["language"])


@query(
    "a25_summary_per_pr",
    "SELECT scan_job_id, 'severity' AS kind, severity AS label, count(*) AS n FROM findings GROUP BY 1, 3 UNION ALL "
    "SELECT scan_job_id, 'file', file_path, count(*) FROM findings GROUP BY 1, 3",
    "findings",
)
def _(t):
    sets = t.findings.groupingSets(
        [["scan_job_id", "severity"], ["scan_job_id", "file_path"]], "scan_job_id", "severity", "file_path"
    )
    return sets.agg(F.grouping("file_path").alias("g"), F.count("*").alias("n")).select(
        "scan_job_id",
        F.when(F.col("g") == 1, "severity").otherwise("file").alias("kind"),
        F.coalesce("severity", "file_path").alias("label"),
        "n",
    )


@query(
    "f16_relative_paths",
    "SELECT id, file_path AS path, '**' || file_path || ':' || CAST(line_number AS VARCHAR) || '**' || chr(10) || chr(10) || 'text' AS fallback "
    "FROM findings",
    "findings",
)
def _(t):
    root = F.concat(F.lit("/clones/org_"), F.col("scan_job_id").cast("string"))
    path = fo.relative_path(F.concat(root, F.lit("/"), "file_path"), root)
    return t.findings.select(
        "id", path.alias("path"), doc.fallback_comment(path, F.col("line_number"), F.lit("text")).alias("fallback")
    )


@query(
    "f23_rounding",
    "SELECT id, round_even(llm_confidence * 10 + 0.127, 2) AS two_places FROM findings",
    "findings",
)
def _(t):
    return t.findings.select("id", F.bround(F.col("llm_confidence") * 10 + 0.127, 2).alias("two_places"))


# ----------------------------------------------------- reports and messages

_NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY scan_job_id ORDER BY id) AS rn, count(*) OVER (PARTITION BY scan_job_id) AS total FROM findings)"


_FRAMED = (
    "c AS (SELECT j.id AS scan_job_id, count(f.id) AS k FROM scan_jobs j LEFT JOIN findings f ON f.scan_job_id = j.id GROUP BY 1)"
)


def _entries_of(rows, ddl):
    """Rows of JSON documents with the entries parsed as ``e``; head and foot keep their ``text``."""
    comma = F.col("text").startswith(",")
    entry = F.when(~F.col("text").rlike("^(\\]|\\{\"(total_findings|version)\")"), F.expr("ltrim(',', text)"))
    return rows.withColumns({"comma": comma, "e": F.from_json(entry, ddl)}).withColumn("frame", F.when(F.col("e").isNull(), F.col("text")))


@query(
    "k01_json_reports",
    f"WITH {_NUMBERED}, {_FRAMED} SELECT scan_job_id, rn AS number, rn > 1 AS comma, CAST(NULL AS VARCHAR) AS frame, tool, severity, confidence, description, "
    "file_path, line_number, code_snippet, rule_id FROM n UNION ALL SELECT scan_job_id, 0, false, '{\"total_findings\":' || CAST(k AS VARCHAR) || "
    "',\"findings\":[', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c UNION ALL SELECT scan_job_id, k + 1, false, ']}', NULL, NULL, NULL, NULL, "
    "NULL, NULL, NULL, NULL FROM c",
    "findings scan_jobs",
)
def _(t):
    jobs = t.scan_jobs.select(F.col("id").alias("scan_job_id"))
    rows = doc.json_report(t.findings, ["scan_job_id"], ["id"], _ids(), jobs)
    ddl = (
        "tool string, severity string, confidence string, description string, file_path string, line_number int, code_snippet string, "
        "rule_id string"
    )
    return _entries_of(rows, ddl).select("scan_job_id", "number", "comma", "frame", "e.*")


@query(
    "k02_sarif_reports",
    f"WITH {_NUMBERED}, {_FRAMED} SELECT scan_job_id, rn AS number, rn > 1 AS comma, CAST(NULL AS VARCHAR) AS frame, rule_id, CASE severity WHEN 'CRITICAL' THEN "
    "'error' WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' ELSE 'warning' END AS level, description AS message, file_path AS uri, line_number "
    "AS start_line FROM n UNION ALL SELECT scan_job_id, 0, false, '{\"version\":\"2.1.0\",\"$schema\":\"https://raw.githubusercontent.com/oasis-tcs/"
    "sarif-spec/master/Schemata/sarif-schema-2.1.0.json\",\"runs\":[{\"tool\":{\"driver\":{\"name\":\"triagelake\",\"version\":\"1.0.0\"}},\"results\":[', "
    "NULL, NULL, NULL, NULL, NULL FROM c UNION ALL SELECT scan_job_id, k + 1, false, ']}]}', NULL, NULL, NULL, NULL, NULL FROM c",
    "findings scan_jobs",
)
def sarif(t):
    jobs = t.scan_jobs.select(F.col("id").alias("scan_job_id"))
    rows = doc.sarif_report(t.findings, ["scan_job_id"], ["id"], _ids(), jobs)
    ddl = (
        "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<"
        "artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    )
    place = F.col("e.locations")[0]["physicalLocation"]
    return _entries_of(rows, ddl).select(
        "scan_job_id",
        "number",
        "comma",
        "frame",
        F.col("e.ruleId").alias("rule_id"),
        F.col("e.level").alias("level"),
        F.col("e.message.text").alias("message"),
        place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("start_line"),
    )


@query(
    "k03_text_report",
    f"WITH {_NUMBERED} SELECT scan_job_id, rn AS number, CAST(rn AS VARCHAR) || '. ' || CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' "
    "WHEN 'MEDIUM' THEN '🟡' WHEN 'LOW' THEN '🟢' ELSE '⚠️' END || ' [' || severity || '] ' || rule_id || chr(10) || '   File: ' || file_path || ':' || "
    "CAST(line_number AS VARCHAR) || chr(10) || '   Tool: ' || tool || chr(10) || '   Description: ' || description || chr(10) AS text FROM n "
    "WHERE severity <> 'none' UNION ALL SELECT j.id, 0, CASE WHEN c.k IS NULL THEN '✅ No security issues found!' ELSE chr(10) || '🔍 Found ' || "
    "CAST(c.k AS VARCHAR) || ' security issue(s):' || chr(10) END FROM scan_jobs j LEFT JOIN (SELECT scan_job_id, count(*) AS k FROM findings GROUP BY 1) c "
    "ON j.id = c.scan_job_id",
    "findings scan_jobs",
)
def _(t):
    jobs = t.scan_jobs.select(F.col("id").alias("scan_job_id"))
    return doc.text_report(t.findings, jobs, "scan_job_id", ["id"], _ids())


def _url():
    return F.concat(F.lit("https://host.example/pr/"), F.col("scan_job_id").cast("string"))


@query(
    "k07_slack_payloads",
    "SELECT id, CASE severity WHEN 'CRITICAL' THEN '🔴' ELSE '🟠' END || ' Security Issue Found' AS title, '*Severity:*' || chr(10) || severity AS severity, "
    "'*Line:*' || chr(10) || CAST(line_number AS VARCHAR) AS line, '*Description:*' || chr(10) || description AS description, "
    "'<https://host.example/pr/' || CAST(scan_job_id AS VARCHAR) || '|View Pull Request>' AS link FROM findings WHERE severity IN ('CRITICAL', 'HIGH')",
    "findings",
)
def _(t):
    out = doc.notifications(t.findings, _url(), "slack")
    at = lambda path: F.get_json_object("payload", path)
    return out.select(
        "id",
        at("$.blocks[0].text.text").alias("title"),
        at("$.blocks[1].fields[0].text").alias("severity"),
        at("$.blocks[1].fields[3].text").alias("line"),
        at("$.blocks[2].text.text").alias("description"),
        at("$.blocks[3].text.text").alias("link"),
    )


@query(
    "k08_discord_payloads",
    "SELECT id, '🔒 Security Issue Found' AS title, CASE severity WHEN 'CRITICAL' THEN '16711680' WHEN 'HIGH' THEN '16737792' WHEN 'MEDIUM' THEN '16776960' "
    "WHEN 'LOW' THEN '65280' ELSE '16776960' END AS color, file_path AS file, CAST(line_number AS VARCHAR) AS line, 'https://host.example/pr/' || "
    "CAST(scan_job_id AS VARCHAR) AS url FROM findings",
    "findings",
)
def _(t):
    out = doc.notifications(t.findings, _url(), "discord", "LOW")
    at = lambda path: F.get_json_object("payload", path)
    return out.select(
        "id",
        at("$.embeds[0].title").alias("title"),
        at("$.embeds[0].color").alias("color"),
        at("$.embeds[0].fields[2].value").alias("file"),
        at("$.embeds[0].fields[3].value").alias("line"),
        at("$.embeds[0].url").alias("url"),
    )


_COMMENT = (
    "CASE llm_decision WHEN 'true_positive' THEN '🚨' WHEN 'false_positive' THEN '✅' ELSE '⚠️' END || ' **Security Finding: ' || rule_id || '**' || chr(10) || chr(10) || "
    "'**Decision**: ' || CASE llm_decision WHEN 'true_positive' THEN 'True Positive' WHEN 'false_positive' THEN 'False Positive' ELSE 'Uncertain' END || chr(10) || "
    "'**Confidence**: ' || CAST(o AS VARCHAR) || '%' || chr(10) || '**Severity**: ' || CASE WHEN id % 2 = 0 THEN llm_severity ELSE severity END || chr(10) || chr(10) || "
    "'**Reasoning**: ' || llm_reasoning || CASE WHEN id % 3 = 0 THEN chr(10) || chr(10) || '**Remediation**: Replace it' ELSE '' END || CASE WHEN id % 5 = 0 THEN chr(10) || chr(10) || "
    "'**CWE**: [CWE-89](https://cwe.mitre.org/data/definitions/89.html), [CWE-79](https://cwe.mitre.org/data/definitions/79.html)' ELSE '' END || chr(10) || chr(10) || "
    "'---' || chr(10) || '*Analyzed by triagelake*'"
)


def _reviewed(t):
    none = F.lit(None).cast("string")
    return t.findings.select(
        "*",
        F.col("llm_decision").alias("v_decision"),
        F.col("llm_confidence").alias("v_confidence"),
        F.when(F.col("id") % 2 == 0, F.col("llm_severity")).alias("v_severity"),
        F.col("llm_reasoning").alias("v_reasoning"),
        none.alias("v_exploitability"),
        F.when(F.col("id") % 3 == 0, F.lit("Replace it")).alias("v_remediation"),
        F.when(F.col("id") % 5 == 0, F.array(F.lit("CWE-89"), F.lit("CWE-79"))).alias("v_cwe_ids"),
    )


@query(
    "f15_comment_bodies",
    f"SELECT id, {_COMMENT} AS body FROM (SELECT *, CAST(id % 101 AS INT) AS o FROM findings) f",
    "findings",
)
def _(t):
    return _reviewed(t).select("id", doc.comment_body().alias("body"))


@query(
    "k09_review_comments",
    "WITH g AS (SELECT scan_job_id, count(*) AS n FROM findings WHERE llm_decision = 'true_positive' GROUP BY 1) SELECT j.id AS scan_job_id, CASE WHEN g.n IS NULL "
    "THEN 'none' ELSE 'summary' END AS kind, CAST(NULL AS VARCHAR) AS path, 0 AS line, CASE WHEN g.n IS NULL THEN '✅ **Security Scan Complete** - No verified "
    "security issues found!' ELSE '🔒 **Security Scan Complete**' || chr(10) || chr(10) || 'Found **' || CAST(g.n AS VARCHAR) || ' verified security issues** in this PR.' || chr(10) || chr(10) || "
    f"'See inline comments for details.' END AS body FROM scan_jobs j LEFT JOIN g ON j.id = g.scan_job_id UNION ALL SELECT scan_job_id, 'inline', file_path, line_number, {_COMMENT} "
    "FROM (SELECT *, CAST(id % 101 AS INT) AS o FROM findings WHERE llm_decision = 'true_positive') f",
    "findings scan_jobs",
)
def _(t):
    jobs = t.scan_jobs.select(F.col("id").alias("scan_job_id"))
    return doc.review_comments(_reviewed(t), jobs).withColumn("line", F.coalesce("line", F.lit(0)))


@query(
    "k06_compliance_documents",
    "SELECT scan_job_id, greatest(0, 100 - 10 * count(*) FILTER (WHERE severity = 'CRITICAL') - 5 * count(*) FILTER (WHERE severity = 'HIGH')) AS score, "
    "CAST(least(10, count(*) FILTER (WHERE lower(description) LIKE '%password%' OR lower(description) LIKE '%key%' OR lower(description) LIKE '%token%' OR "
    "lower(description) LIKE '%secret%' OR lower(description) LIKE '%credential%')) AS INT) AS listed FROM findings GROUP BY 1",
    "findings",
)
def _(t):
    from triagelake.operators import compliance

    out = compliance.report(t.findings, "SOC2", "scan_job_id", ["id"], F.lit("2024-01-01T00:00:00"))
    ddl = "compliance_score int, principles struct<confidentiality:struct<findings:array<struct<rule_id:string>>>>"
    parsed = out.withColumn("r", F.from_json("report", ddl))
    listed = F.coalesce(F.size("r.principles.confidentiality.findings"), F.lit(0))
    return parsed.select(
        "scan_job_id",
        F.col("r.compliance_score").cast("long").alias("score"),
        F.when(listed < 0, 0).otherwise(listed).alias("listed"),
    )
