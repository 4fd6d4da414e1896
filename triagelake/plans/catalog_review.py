"""Review requests and verdicts, fixes, throttling: queries and SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from triagelake.functions import prompts
from triagelake.operators import fixes, review, throttle
from triagelake.plans.proxies import offline_completer
from triagelake.plans.registry import query
from triagelake.session import local_table


def _q(text: str) -> str:
    """A Python text as an SQL expression."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


_TASK = _q("\n".join(prompts.TASK_LINES))

# ----------------------------------------------------------------- requests


@query(
    "f08_review_requests",
    "SELECT id, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE tool END AS sast_tool, rule_id, severity, CASE WHEN id % 5 = 0 THEN '' ELSE description END "
    "AS description, code_snippet AS code_context, file_path, line_number FROM findings",
    "findings",
)
def _(t):
    rows = t.findings.withColumn("tool", F.when(F.col("id") % 7 != 0, F.col("tool"))).withColumn(
        "description", F.when(F.col("id") % 5 != 0, F.col("description"))
    )
    return prompts.review_request(rows).select(
        "id", "sast_tool", "rule_id", "severity", "description", "code_context", "file_path", "line_number"
    )


def _with_context(t):
    none = F.lit(None).cast("string")
    return t.findings.withColumn(
        "context",
        F.when(
            F.col("id") % 2 == 0,
            F.struct(
                F.concat(F.lit("def f():\n    "), "code_snippet").alias("context_code"),
                F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), F.col("id").cast("string"))).alias("function_name"),
                F.when(F.col("id") % 4 == 0, F.lit("Box")).otherwise(none).alias("class_name"),
            ),
        ),
    )


_PROMPT = (
    "'**SAST Finding to Verify:**' || chr(10) || '- Tool: ' || tool || chr(10) || '- Rule: ' || rule_id || chr(10) || '- Severity: ' || severity || chr(10) || "
    "'- Description: ' || description || chr(10) || '- Location: ' || file_path || ':' || CAST(line_number AS VARCHAR) || chr(10) || "
    "CASE WHEN id % 6 = 0 THEN '- Function: f' || CAST(id AS VARCHAR) || chr(10) ELSE '' END || CASE WHEN id % 4 = 0 THEN '- Class: Box' || chr(10) ELSE '' END || "
    "chr(10) || '**Code Context:**' || chr(10) || '```' || chr(10) || CASE WHEN id % 2 = 0 THEN 'def f():' || chr(10) || '    ' ELSE '' END || code_snippet || chr(10) || '```' || chr(10) || "
    + _TASK
)


@query("f06_review_prompts", f"SELECT id, {_q(prompts.EXAMPLES_TEXT + prompts.EXAMPLES_SEPARATOR)} || {_PROMPT} AS prompt FROM findings", "findings")
def _(t):
    rows = prompts.review_request(_with_context(t))
    return rows.select("id", prompts.review_prompt().alias("prompt"))


@query(
    "f07_batch_prompts",
    "WITH n AS (SELECT *, row_number() OVER (PARTITION BY scan_job_id ORDER BY id) AS rn FROM findings), b AS (SELECT scan_job_id, (rn - 1) // 8 AS batch, "
    "count(*) AS findings, string_agg('## Finding ' || CAST((rn - 1) % 8 + 1 AS VARCHAR) || ':' || chr(10) || '- Rule: ' || rule_id || chr(10) || '- Description: ' || description || chr(10) || "
    "'- Code: ' || substr(code_snippet, 1, 100) || '...' || chr(10), chr(10) ORDER BY rn) AS body FROM n GROUP BY 1, 2) SELECT scan_job_id, batch, findings, "
    "'**Batch Verification Request:**' || chr(10) || 'You are verifying ' || CAST(findings AS VARCHAR) || ' SAST findings.' || chr(10) || chr(10) || "
    "'Decide on each of them.' || chr(10) || chr(10) || body AS prompt FROM b",
    "findings",
)
def _(t):
    return prompts.batch_prompts(t.findings, ["scan_job_id"], ["id"], F.floor(F.col("id") / 4096), 8)


# ----------------------------------------------------------------- verdicts


def _responses(t):
    """Responses of which some are no JSON, some break a rule of the verdict."""
    good = F.to_json(
        F.struct(
            F.when(F.col("id") % 11 == 0, "maybe").otherwise(F.col("llm_decision")).alias("decision"),
            (F.col("llm_confidence") + F.when(F.col("id") % 13 == 0, 1.5).otherwise(0.0)).alias("confidence"),
            F.when(F.col("id") % 17 == 0, "short").otherwise(F.col("llm_reasoning")).alias("reasoning"),
            F.when(F.col("id") % 3 == 0, F.col("llm_severity")).alias("severity"),
            F.when(F.col("id") % 19 == 0, F.repeat(F.lit("x"), 301)).otherwise("Replace it").alias("remediation"),
            F.array(F.lit("CWE-1"), F.lit("CWE-2")).alias("cwe_ids"),
        )
    )
    content = F.when(F.col("id") % 23 == 0, "I cannot answer").otherwise(good)
    return t.findings.select("id", content.alias("content"))


_VALID = (
    "v AS (SELECT *, id % 23 <> 0 AND id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AND id % 19 <> 0 AS valid, CASE WHEN id % 23 = 0 THEN 'decision, confidence, reasoning' ELSE "
    "array_to_string(list_filter([CASE WHEN id % 11 = 0 THEN 'decision' END, CASE WHEN id % 13 = 0 THEN 'confidence' END, CASE WHEN id % 17 = 0 THEN 'reasoning' END, "
    "CASE WHEN id % 19 = 0 THEN 'remediation' END], lambda x: x IS NOT NULL), ', ') END AS bad FROM findings)"
)


@query(
    "p17_verdict_check",
    f"WITH {_VALID} SELECT id, valid FROM v",
    "findings",
)
def _(t):
    return review.parse_verdicts(_responses(t)).select("id", "valid")


@query(
    "p18_verdict_fallback",
    f"WITH {_VALID} SELECT id, decision, confidence, reasoning FROM (SELECT id, CASE WHEN valid THEN llm_decision ELSE 'uncertain' END AS decision, "
    "CASE WHEN valid THEN llm_confidence ELSE CAST(0.0 AS DOUBLE) END AS confidence, CASE WHEN valid THEN llm_reasoning ELSE 'Verification failed due to error: invalid ' || bad END "
    "AS reasoning FROM v) z",
    "findings",
)
def _(t):
    return review.parse_verdicts(_responses(t)).select("id", "decision", "confidence", "reasoning")


@query(
    "f09_parse_responses",
    f"WITH {_VALID} SELECT id, CASE WHEN valid AND id % 3 = 0 THEN llm_severity END AS severity, CASE WHEN valid THEN 'Replace it' END AS remediation, "
    "CASE WHEN valid THEN 'CWE-1,CWE-2' END AS cwe FROM v",
    "findings",
)
def _(t):
    out = review.parse_verdicts(_responses(t))
    return out.select("id", "severity", "remediation", F.array_join("cwe_ids", ",").alias("cwe"))


_DECIDED = (
    "CASE WHEN description = 'Hardcoded password in source' THEN 'true_positive' WHEN description = 'Unchecked buffer length' THEN 'false_positive' "
    "ELSE 'uncertain' END"
)


@query(
    "h04_review_run",
    f"SELECT id, {_DECIDED} AS decision, CASE WHEN description = 'Hardcoded password in source' THEN CAST(0.95 AS DOUBLE) WHEN description = 'Unchecked buffer length' "
    "THEN CAST(0.8 AS DOUBLE) WHEN description = 'Graphic cache path is predictable' THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, "
    "description <> 'Graphic cache path is predictable' AS valid FROM findings",
    "findings",
)
def review_run(t):
    snapshot = local_table(t.spark, [], "key string, path string, payload string, cached_at timestamp, ttl_s long")
    out = review.review(t.findings, snapshot, offline_completer)
    return out.select("id", "decision", "confidence", "valid")


@query(
    "h04_review_with_cache",
    f"SELECT id, CASE WHEN severity = 'HIGH' THEN 'false_positive' ELSE {_DECIDED} END AS decision FROM findings",
    "findings",
)
def _(t):
    """Requests of HIGH findings are already answered in the cache."""
    asked = review.requests_of(t.findings, "gpt-4o")
    answer = F.lit('{"decision": "false_positive", "confidence": 0.9, "reasoning": "answered before"}')
    snapshot = (
        asked.where("severity = 'HIGH'")
        .select("key")
        .distinct()
        .select(
            "key",
            F.lit(None).cast("string").alias("path"),
            answer.alias("payload"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("cached_at"),
            F.lit(86400).cast("long").alias("ttl_s"),
        )
    )
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return review.review(t.findings, snapshot, offline_completer, now=now).select("id", "decision")


def _by_length(texts: list[str]) -> list[str]:
    """Stand-in for a model whose answer depends on the whole text."""
    kinds = ("true_positive", "false_positive", "uncertain")
    return [json.dumps({"decision": kinds[len(x) % 3], "confidence": len(x) % 11 / 10, "reasoning": f"{len(x)} characters were read."}) for x in texts]


@query(
    "h03_batched_completion",
    "SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'uncertain' END AS decision, "
    "CAST(length(text) % 11 AS DOUBLE) / 10 AS confidence, CAST(length(text) AS VARCHAR) || ' characters were read.' AS reasoning FROM documents",
)
def _(t):
    asked = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("prompt"))
    done = review.complete_prompts(asked, _by_length, batch=5)
    out = review.parse_verdicts(done.select("key", "content"))
    return out.select(F.col("key").cast("long").alias("doc_id"), "decision", "confidence", "reasoning")


@query("f19_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", prompts.token_estimate(F.col("text")).alias("tokens"))


# -------------------------------------------------------------------- fixes

_FENCE = "'```'"


@query(
    "f10_clean_code",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'x' || chr(10) || '```' || chr(10) || 'y' ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END AS code FROM documents",
)
def _(t):
    body = F.col("text")
    wrapped = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```python\n"), body, F.lit("\n```")))
        .when(F.col("doc_id") % 3 == 1, F.concat(body, F.lit("\n```  ")))
        .otherwise(F.lit("x\n```\ny\n"))
    )
    return t.documents.select("doc_id", prompts.clean_code(wrapped).alias("code"))


@query(
    "f11_split_fix_response",
    "SELECT id, CASE WHEN id % 3 = 2 THEN code_snippet || chr(10) || '**Explanation**: a **Explanation**: b' ELSE code_snippet END AS code, CASE WHEN id % 3 = 0 THEN description "
    "ELSE 'Security fix applied' END AS explanation FROM findings",
    "findings",
)
def _(t):
    response = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("```\n"), "code_snippet", F.lit("\n```\n\n**Explanation**: "), "description", F.lit("\n")))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("```py\n"), "code_snippet", F.lit("\n```")))
        .otherwise(F.concat("code_snippet", F.lit("\n**Explanation**: a **Explanation**: b")))
    )
    code, explanation = prompts.split_fix_response(response)
    return t.findings.select("id", code.alias("code"), explanation.alias("explanation"))


_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{kind}', [{', '.join(chr(39) + r + chr(39) for r in rules)}], [{', '.join(chr(39) + x + chr(39) for x in langs)}], {_q(guide)}, "
    f"'{','.join(imports)}', '{expl.replace(chr(39), chr(39) * 2)}')"
    for i, (kind, rules, langs, guide, imports, expl) in enumerate(fixes.TEMPLATES)
)
_MATCHED = (
    f"tpl AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) v(ord, kind, rules, langs, guide, imports, expl)), m AS (SELECT f.*, (SELECT min(ord) FROM tpl WHERE list_contains(rules, f.rule_id) "
    "AND list_contains(langs, f.language)) AS ord FROM findings f), mt AS (SELECT m.*, t.kind, t.guide, t.imports, t.expl FROM m LEFT JOIN tpl t ON m.ord = t.ord)"
)


@query(
    "j11_match_templates",
    f"WITH {_MATCHED} SELECT id, rule_id, kind AS vulnerability_type FROM mt",
    "findings",
)
def _(t):
    out = fixes.match_templates(t.findings, fixes.template_table(t.spark))
    return out.select("id", "rule_id", "vulnerability_type")


@query(
    "a26_supported_rules_in_findings",
    f"WITH {_MATCHED} SELECT language, rule_id, count(*) AS n FROM mt WHERE ord IS NOT NULL GROUP BY 1, 2",
    "findings",
)
def _(t):
    """How often rules that have a fix template occur, by language."""
    supported = fixes.supported_rules(fixes.template_table(t.spark))
    pairs = supported.select("language", F.explode("rule_ids").alias("rule_id"))
    return t.findings.join(pairs, ["language", "rule_id"]).groupBy("language", "rule_id").agg(F.count("*").alias("n"))


_FIX_PROMPT = (
    "CASE WHEN kind IS NOT NULL THEN 'Repair the weakness below along the lines of the template.' || chr(10) || chr(10) || '**Vulnerability**: ' || description || chr(10) || "
    "'**Rule**: ' || rule_id || chr(10) || chr(10) || '**Original Code**:' || chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) || chr(10) || '**Fix Template**:' || chr(10) || "
    f"guide || chr(10) || chr(10) || {_q(chr(10).join(prompts.FIX_INSTRUCTIONS))} || chr(10) || '3. Answer with the fixed code only' || chr(10) || chr(10) || '**Fixed Code**:' ELSE "
    "'Repair the weakness below.' || chr(10) || chr(10) || '**Vulnerability**: ' || description || chr(10) || '**Rule**: ' || rule_id || chr(10) || '**Severity**: ' || severity || chr(10) || "
    "'**File**: ' || file_path || chr(10) || '**Line**: ' || CAST(line_number AS VARCHAR) || chr(10) || chr(10) || '**Original Code**:' || chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) || chr(10) || "
    f"{_q(chr(10).join(prompts.FIX_INSTRUCTIONS))} || chr(10) || '3. Follow the code with a short explanation' || chr(10) || chr(10) || 'Write the code between ``` lines, then ''**Explanation**:'' and the explanation.' END"
)


@query("f12_fix_prompts", f"WITH {_MATCHED} SELECT id, {_FIX_PROMPT} AS prompt FROM mt", "findings")
def _(t):
    return fixes.fix_requests(t.findings, fixes.template_table(t.spark)).select("id", "prompt")


@query(
    "f13_fix_suggestions",
    f"WITH {_MATCHED} SELECT id AS finding_id, rule_id, 'safe(' || code_snippet || ')' AS fixed_code, CASE WHEN kind IS NULL THEN 'why ' || rule_id ELSE expl END AS explanation, "
    "CAST(CASE WHEN kind IS NULL THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence, coalesce(imports, '') AS imports, kind AS template_used FROM mt",
    "findings",
)
def _(t):
    asked = fixes.fix_requests(t.findings, fixes.template_table(t.spark))
    code = F.concat(F.lit("```\nsafe("), "code_snippet", F.lit(")\n```"))
    response = F.when(F.col("template").isNotNull(), code).otherwise(
        F.concat(code, F.lit("\n**Explanation**: why "), "rule_id")
    )
    out = fixes.suggestions(asked.withColumn("response", response))
    return out.select(
        "finding_id",
        "rule_id",
        "fixed_code",
        "explanation",
        "confidence",
        F.array_join("imports_needed", ",").alias("imports"),
        "template_used",
    )


@query(
    "f14_line_changes",
    "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS o FROM documents), "
    "x AS (SELECT doc_id, i, CAST(i AS VARCHAR) || ':' || o[i] AS line FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM s) t), "
    "y AS (SELECT *, string_split(replace(line, ', ', ',' || chr(10)), chr(10)) AS p FROM x), "
    "z AS (SELECT *, coalesce(sum(len(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM y) "
    "SELECT doc_id, '-' AS op, CAST(i AS INT) AS line_number, line FROM z WHERE len(p) > 1 UNION ALL "
    "SELECT doc_id, '+', CAST(b + k AS INT), p[k] FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM z WHERE len(p) > 1) q",
)
def _(t):
    """Numbered lines broken after their commas: many hunks a text, with unchanged lines between them."""
    numbered = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x)), "\n")
    rows = t.documents.select("doc_id", numbered.alias("original_code"), F.replace(numbered, F.lit(", "), F.lit(",\n")).alias("fixed_code"))
    return fixes.line_changes(rows, "doc_id")


@query(
    "j14_apply_fixes",
    "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, replace(replace(text, lang, '<' || lang || '>'), '>.', '>!') AS content, text AS backup FROM documents",
)
def _(t):
    steps = t.documents.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.explode(
            F.array(
                F.struct(F.lit(2).alias("ord"), F.lit(">.").alias("original_code"), F.lit(">!").alias("fixed_code")),
                F.struct(
                    F.lit(1).alias("ord"),
                    F.col("lang").alias("original_code"),
                    F.concat(F.lit("<"), "lang", F.lit(">")).alias("fixed_code"),
                ),
                F.struct(F.lit(3).alias("ord"), F.lit(" \n").alias("original_code"), F.lit("!").alias("fixed_code")),
            )
        ).alias("s"),
    ).select("file_path", "s.*")
    return fixes.apply_fixes(t.source_files, steps).select("file_path", "content", "backup")


@query(
    "p21_real_fixes",
    "SELECT id, id % 4 NOT IN (0, 1) AS ok FROM findings",
    "findings",
)
def _(t):
    fixed = (
        F.when(F.col("id") % 4 == 0, F.lit(" \n"))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("\n "), "code_snippet", F.lit(" \n")))
        .otherwise(F.concat("code_snippet", F.lit(";")))
    )
    return t.findings.select("id", fixes.is_real_fix(F.col("code_snippet"), fixed).alias("ok"))


@query(
    "p22_fix_acceptance",
    "SELECT id, CASE WHEN llm_confidence >= 0.8 THEN 'accept' WHEN llm_confidence < 0.7 THEN 'review' ELSE 'consider' END AS verdict FROM findings",
    "findings",
)
def _(t):
    return t.findings.select("id", fixes.acceptance(F.col("llm_confidence")).alias("verdict"))


@query(
    "p23_syntax_check",
    "SELECT id, language <> 'python' OR id % 2 = 0 AS ok, CASE language WHEN 'python' THEN CASE WHEN id % 2 = 0 THEN '' ELSE 'Unmatched brackets: (' END "
    "WHEN 'javascript' THEN 'Validation skipped (Node.js not available)' WHEN 'typescript' THEN 'Validation skipped (TypeScript not available)' "
    "WHEN 'go' THEN 'Validation skipped (Go not available)' ELSE 'Validation skipped (Rust not available)' END AS message FROM findings",
    "findings",
)
def _(t):
    code = F.when(F.col("id") % 2 == 0, F.concat(F.lit("a = 1\n"), "code_snippet")).otherwise(F.lit("a = [1, ')']  # ]\nb = (2\n"))
    out = t.findings.select("id", fixes.syntax_check(code, F.col("language")).alias("c"))
    return out.select("id", "c.ok", "c.message")


# ----------------------------------------------------------------- throttle

BUCKET_SQL = (
    "WITH RECURSIVE r AS (SELECT event_id AS request_id, 'user' || CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "walk AS (SELECT request_id, key, us, n, TRUE AS admitted, CAST(2 AS DOUBLE) AS allowance FROM r WHERE n = 1 UNION ALL "
    "SELECT r.request_id, r.key, r.us, r.n, least(3.0, w.allowance + (r.us / 1000000.0 - w.us / 1000000.0) * 3.0 / 86400.0) >= 1.0, "
    "CASE WHEN least(3.0, w.allowance + (r.us / 1000000.0 - w.us / 1000000.0) * 3.0 / 86400.0) >= 1.0 THEN "
    "least(3.0, w.allowance + (r.us / 1000000.0 - w.us / 1000000.0) * 3.0 / 86400.0) - 1.0 ELSE "
    "least(3.0, w.allowance + (r.us / 1000000.0 - w.us / 1000000.0) * 3.0 / 86400.0) END FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1) "
    "SELECT request_id, key, admitted FROM walk"
)


@query("w05_token_bucket", BUCKET_SQL)
def token_bucket(t):
    return throttle.token_bucket(t.requests, 3, 86400)
