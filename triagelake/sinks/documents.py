"""Reports, messages and comments made from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import severity as sev
from triagelake.operators.ordered import running_number

REPORT_FIELDS = [
    "tool",
    "severity",
    "confidence",
    "description",
    "file_path",
    "line_number",
    "code_snippet",
    "rule_id",
]
# Fixed values.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
TOOL_NAME = "triagelake"
TOOL_VERSION = "1.0.0"
NO_ISSUES = "✅ No security issues found!"
SUMMARY_TEXT = (
    "🔒 **Security Scan Complete**\n\nFound **",
    " verified security issues** in this PR.\n\nSee inline comments for details.",
)
NOTHING_TEXT = "✅ **Security Scan Complete** - No verified security issues found!"
CWE_URL = "https://cwe.mitre.org/data/definitions/"


def _document_rows(
    findings: DataFrame,
    by: list[str],
    order: list[str],
    chunk: Column,
    entry: Column,
    head: Column,
    foot: str,
    empty: Column | None = None,
    jobs: DataFrame | None = None,
) -> DataFrame:
    """One document per job as rows ``(by, number, text)``: a head at 0, the entries from 1 in ``order``, a foot.

    ``head`` may use the job's number of findings ``n``. Written in the order of ``(by, number)`` the rows are
    the document, whatever its size: no task or row gathers a job. The jobs are those of ``jobs``, with or
    without findings (a job without any that has an ``empty`` text is that one row), or else those that have findings.
    """
    numbered = running_number(findings, by, order, chunk, "number")
    entries = numbered.select(*by, "number", entry.alias("text"))
    if by:
        counts = findings.groupBy(*by).agg(F.count("*").alias("n"))
    else:
        counts = findings.agg(F.count("*").alias("n"))
    if jobs is not None:
        same = [jobs[c].eqNullSafe(counts[c]) for c in by]
        counts = jobs.join(counts, same, "left").select(*[jobs[c] for c in by], F.coalesce("n", F.lit(0)).alias("n"))
    none = F.lit(False) if empty is None else F.col("n") == 0
    first = F.when(none, F.lit(None) if empty is None else empty).otherwise(head)
    ends = F.array(F.struct(F.lit(0).cast("long").alias("number"), first.alias("text")))
    if foot:
        last = F.array(F.struct((F.col("n") + 1).alias("number"), F.lit(foot).alias("text")))
        ends = F.when(none, ends).otherwise(F.concat(ends, last))
    framed = counts.select(*by, F.explode(ends).alias("e")).select(*by, "e.number", "e.text")
    return entries.unionByName(framed)


def _json_entry(entry: Column, options: dict[str, str]) -> Column:
    """One element of a JSON array, with the comma that parts it from the element before."""
    return F.concat(F.when(F.col("number") > 1, ",").otherwise(""), F.to_json(entry, options))


def json_report(
    findings: DataFrame, by: list[str], order: list[str], chunk: Column, jobs: DataFrame | None = None
) -> DataFrame:
    """A JSON report ``{total_findings, findings}`` per job, as rows for :func:`write_documents`."""
    entry = F.struct(*[F.col(c) for c in REPORT_FIELDS if c in findings.columns])
    head = F.concat(F.lit('{"total_findings":'), F.col("n").cast("string"), F.lit(',"findings":['))
    return _document_rows(
        findings, by, order, chunk, _json_entry(entry, {"ignoreNullFields": "false"}), head, "]}", jobs=jobs
    )


def sarif_result() -> Column:
    """One finding as a SARIF result."""
    return F.struct(
        F.coalesce("rule_id", F.lit("unknown")).alias("ruleId"),
        sev.sarif_level(F.col("severity")).alias("level"),
        F.struct(F.coalesce("description", F.lit("Security issue found")).alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.coalesce("file_path", F.lit("unknown")).alias("uri")).alias("artifactLocation"),
                    F.struct(F.coalesce("line_number", F.lit(1)).alias("startLine")).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
    )


def sarif_report(
    findings: DataFrame, by: list[str], order: list[str], chunk: Column, jobs: DataFrame | None = None
) -> DataFrame:
    """A SARIF document per job, as rows for :func:`write_documents`."""
    head = (
        f'{{"version":"{SARIF_VERSION}","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'
        f'{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}"}}}},"results":['
    )
    return _document_rows(
        findings, by, order, chunk, _json_entry(sarif_result(), {}), F.lit(head), "]}]}", jobs=jobs
    )


def text_entry(number: Column) -> Column:
    """One finding as numbered text."""
    unknown = F.lit("unknown")
    severity = F.coalesce("severity", F.lit("UNKNOWN"))
    return F.concat(
        number.cast("string"), F.lit(". "), sev.severity_marker(severity), F.lit(" ["), severity, F.lit("] "),
        F.coalesce("rule_id", unknown),
        F.lit("\n   File: "), F.coalesce("file_path", unknown), F.lit(":"),
        F.coalesce(F.col("line_number").cast("string"), F.lit("?")),
        F.lit("\n   Tool: "), F.coalesce("tool", unknown),
        F.lit("\n   Description: "), F.coalesce("description", F.lit("No description")), F.lit("\n"),
    )


def text_report(
    findings: DataFrame, jobs: DataFrame, by: str, order: list[str], chunk: Column
) -> DataFrame:
    """Text report as rows ``(by, number, text)``: a header at 0, then one row per finding.

    A job without findings has the single row that says so.
    """
    head = F.concat(F.lit("\n🔍 Found "), F.col("n").cast("string"), F.lit(" security issue(s):\n"))
    own = jobs.select(by)
    return _document_rows(
        findings, [by], order, chunk, text_entry(F.col("number")), head, "", F.lit(NO_ISSUES), own
    )


def write_documents(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write the rows of documents in order, range-sorted, one folder per job (none: one document in ``path``).

    A task starts a new file for each job, so the files of a folder, one after another by name, are the document;
    a job has more than one file only where it reaches over several ranges of rows.
    """
    lines = rows.orderBy(*by, "number").select(*by, "text").write.mode("overwrite")
    (lines.partitionBy(*by) if by else lines).text(path)


def comment_body() -> Column:
    """Comment on a reviewed finding (finding columns beside ``v_``-prefixed verdict columns)."""
    cwe = F.transform(
        "v_cwe_ids",
        lambda c: F.concat(F.lit("["), c, F.lit(f"]({CWE_URL}"), F.replace(c, F.lit("CWE-"), F.lit("")), F.lit(".html)")),
    )

    def optional(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"\n**{label}**: "), value))

    none = F.lit("None")
    percent = F.concat(F.bround(F.col("v_confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))
    lines = F.array(
        F.concat(
            sev.decision_marker(F.col("v_decision")), F.lit(" **Security Finding: "), F.coalesce("rule_id", none), F.lit("**")
        ),
        F.lit(""),
        F.concat(F.lit("**Decision**: "), F.initcap(F.replace("v_decision", F.lit("_"), F.lit(" ")))),
        F.concat(F.lit("**Confidence**: "), percent),
        F.concat(F.lit("**Severity**: "), F.coalesce("v_severity", "severity", none)),
        F.concat(F.lit("\n**Reasoning**: "), "v_reasoning"),
        optional("Exploitability", F.col("v_exploitability")),
        optional("Remediation", F.col("v_remediation")),
        optional("CWE", F.array_join(cwe, ", ")),
        F.lit("\n---"),
        F.lit(f"*Analyzed by {TOOL_NAME}*"),
    )
    return F.array_join(F.array_compact(lines), "\n")


def review_comments(reviewed: DataFrame, jobs: DataFrame, by: str = "scan_job_id") -> DataFrame:
    """Comments per PR: a summary and one inline row per true positive, or one "nothing found" row.

    ``reviewed`` holds findings with ``v_`` verdict columns; ``jobs`` the reviewed jobs.
    """
    good = reviewed.where("v_decision = 'true_positive'")
    counts = good.groupBy(by).agg(F.count("*").alias("n"))
    summary = F.concat(F.lit(SUMMARY_TEXT[0]), F.col("n").cast("string"), F.lit(SUMMARY_TEXT[1]))
    nothing = F.lit(NOTHING_TEXT)
    heads = jobs.select(by).join(counts, by, "left").select(
        by,
        F.when(F.col("n").isNotNull(), "summary").otherwise("none").alias("kind"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("int").alias("line"),
        F.coalesce(summary, nothing).alias("body"),
    )
    inline = good.select(
        by,
        F.lit("inline").alias("kind"),
        F.col("file_path").alias("path"),
        F.coalesce("line_number", F.lit(1)).alias("line"),
        comment_body().alias("body"),
    )
    return heads.unionByName(inline)


def fallback_comment(path: Column, line: Column, body: Column) -> Column:
    """A general comment in place of an inline one."""
    return F.concat(F.lit("**"), path, F.lit(":"), line.cast("string"), F.lit("**\n\n"), body)


def _text(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def slack_payload(pr_url: Column) -> Column:
    """Block message of a finding."""
    none = F.lit("None")

    def labelled(label: str, c: str) -> Column:
        return _text("mrkdwn", F.concat(F.lit(f"*{label}:*\n"), F.coalesce(F.col(c).cast("string"), none)))

    fields = F.array(
        labelled("Severity", "severity"),
        labelled("Tool", "tool"),
        labelled("File", "file_path"),
        labelled("Line", "line_number"),
    )
    no_text = F.lit(None).cast("struct<type:string,text:string>")
    no_fields = F.lit(None).cast("array<struct<type:string,text:string>>")

    def block(kind: str, text: Column = no_text, more: Column = no_fields) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), more.alias("fields"))

    title = F.concat(sev.severity_marker(F.coalesce("severity", F.lit("MEDIUM"))), F.lit(" Security Issue Found"))
    blocks = F.array(
        block("header", _text("plain_text", title)),
        block("section", more=fields),
        block("section", labelled("Description", "description")),
        block("section", _text("mrkdwn", F.concat(F.lit("<"), pr_url, F.lit("|View Pull Request>")))),
    )
    return F.to_json(F.struct(blocks.alias("blocks")))


def discord_payload(pr_url: Column) -> Column:
    """Embed message of a finding."""

    def cell(name: str, value: Column, inline: bool) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))

    embed = F.struct(
        F.lit("🔒 Security Issue Found").alias("title"),
        sev.embed_color(F.col("severity")).alias("color"),
        F.array(
            cell("Severity", F.col("severity"), True),
            cell("Tool", F.col("tool"), True),
            cell("File", F.col("file_path"), False),
            cell("Line", F.coalesce(F.col("line_number").cast("string"), F.lit("None")), True),
            cell("Description", F.coalesce("description", F.lit("No description")), False),
        ).alias("fields"),
        pr_url.alias("url"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def notifications(findings: DataFrame, pr_url: Column, channel: str, minimum: str = "HIGH") -> DataFrame:
    """Payload rows of the findings that reach the threshold; batch and streaming alike."""
    make = {"slack": slack_payload, "discord": discord_payload}[channel]
    kept = findings.where(sev.should_notify(F.col("severity"), minimum))
    return kept.select("id", F.lit(channel).alias("channel"), make(pr_url).alias("payload"))
