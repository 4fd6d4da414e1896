"""Findings-shaped views derived from the shared test tables.

Each view is a list of ``column: expression`` pairs whose expressions read the same in
Spark SQL and in ANSI SQL, so the DataFrame plans and their checks start from equal rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared schemas of the test tables: reading them needs no footer scan and infers nothing.
RAW_DDL = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}

_LANG = ["python", "javascript", "typescript", "go", "rust"]


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {arms} ELSE '{values[-1]}' END"


def _by_language(arms: dict[str, str]) -> str:
    body = " ".join(f"WHEN {_LANG.index(k)} THEN {v}" for k, v in list(arms.items())[:-1])
    return f"CASE o_custkey % 5 {body} ELSE {list(arms.values())[-1]} END"


_DESCRIPTIONS = [
    "SQL injection through string formatting",
    "Reflected XSS in template output",
    "Missing CSRF token on form",
    "Weak crypto hash MD5",
    "Hardcoded password in source",
    "API key committed to repository",
    "Personal email address written to log",
    "PII exposed in error message",
    "Patient health record stored without encryption",
    "TLS certificate verification disabled",
    "Audit trail can be bypassed",
    "Missing authorization on access path",
    "Unchecked buffer length",
    "Graphic cache path is predictable",
]

_RULES = {
    "python": ["B303", "B608", "B602", "B105", "B101", "B301"],
    "javascript": ["no-eval", "react/no-danger", "security/detect-sql-injection", "no-undef"],
    "typescript": ["no-eval", "security/detect-object-injection", "@typescript-eslint/no-explicit-any", "no-danger"],
    "go": ["G201", "G401", "G304", "G104"],
    "rust": ["clippy::unwrap_used", "clippy::panic", "clippy::todo", "clippy::unsafe_code"],
}

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "scan_jobs": (
        "customer",
        {
            "id": "c_custkey",
            "repo_full_name": "'org/' || c_name",
            "pr_number": "CAST(1 + c_custkey % 900 AS INT)",
            "commit_sha": "'sha' || CAST(c_custkey AS STRING)",
            "status": _pick("c_custkey % 7", ["failed", "pending", "running", "completed"]),
            "language": _pick("c_custkey % 5", _LANG),
        },
    ),
    "findings": (
        "orders",
        {
            "id": "o_orderkey",
            "scan_job_id": "o_custkey",
            "language": _pick("o_custkey % 5", _LANG),
            "tool": _pick("o_custkey % 5", ["bandit", "eslint", "eslint-typescript", "gosec", "cargo-clippy"]),
            "rule_id": _by_language({k: _pick(f"o_orderkey % {len(v)}", v) for k, v in _RULES.items()}),
            "severity": "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' "
            "WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END",
            "confidence": _pick("o_orderkey % 3", ["HIGH", "MEDIUM", "LOW"]),
            "description": _pick("o_orderkey % 14", _DESCRIPTIONS),
            "file_path": "'src/mod' || CAST(o_custkey % 7 AS STRING) || '/f' || CAST(o_orderkey % 50 AS STRING) || "
            + _pick("o_custkey % 5", [".py", ".js", ".tsx", ".go", ".rs"]),
            "line_number": "CAST(1 + o_orderkey % 40 AS INT)",
            "code_snippet": "'value_' || CAST(o_orderkey % 97 AS STRING) || ' = load(request.args, \"item\")'",
            "llm_decision": "CASE o_orderstatus WHEN 'F' THEN 'true_positive' WHEN 'O' THEN 'false_positive' "
            "ELSE 'uncertain' END",
            "llm_confidence": "CAST(o_orderkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE)",
            "llm_reasoning": "'Reviewed call path ' || CAST(o_orderkey % 89 AS STRING)",
            "llm_severity": _pick("o_orderkey % 4", ["critical", "high", "medium", "low"]),
            "created_at": "o_orderdate",
        },
    ),
    "feedback": (
        "events",
        {
            "id": "event_id",
            "finding_id": "event_id - event_id % 3",
            "user_github_username": "'user' || CAST(user_id AS STRING)",
            "feedback_type": "CASE event_type WHEN 'click' THEN 'true_positive' WHEN 'purchase' THEN 'true_positive' "
            "WHEN 'signup' THEN 'false_negative' ELSE 'false_positive' END",
            "comment": "props",
            "created_at": "ts",
        },
    ),
    "llm_calls": (
        "lineitem",
        {
            "provider": "CASE l_returnflag WHEN 'A' THEN 'openai' WHEN 'N' THEN 'anthropic' ELSE 'google' END",
            "model": "CASE l_returnflag WHEN 'A' THEN "
            + _pick("l_linenumber", ["", "gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-4", "gpt-next"])
            + " WHEN 'N' THEN "
            + _pick(
                "l_linenumber",
                [
                    "",
                    "claude-3-5-sonnet-20241022",
                    "claude-3-opus-20240229",
                    "claude-3-sonnet-20240229",
                    "claude-3-haiku-20240307",
                    "claude-next",
                ],
            )
            + " ELSE "
            + _pick("l_linenumber", ["", "gemini-1.5-pro", "gemini-1.5-flash", "gemini-pro", "gemini-next"])
            + " END",
            "input_tokens": "l_partkey + 1",
            "output_tokens": "CAST(l_quantity * 10 AS BIGINT)",
            "timestamp": "l_shipdate",
            "scan_id": "CAST(l_suppkey AS STRING)",
            "finding_id": "CAST(l_orderkey AS STRING)",
        },
    ),
    "metric_samples": (
        "events",
        {
            "sample_id": "event_id",
            "ts": "ts",
            "language": _pick("user_id % 5", _LANG),
            "scanner": _pick("user_id % 3", ["bandit", "eslint", "gosec"]),
            "provider": _pick("user_id % 3", ["openai", "anthropic", "google"]),
            "model": _pick("user_id % 4", ["small", "medium", "large", "huge"]),
            "status": "CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END",
            "kind": "event_type",
            "value": "value",
            "duration": "value / CAST(20 AS DOUBLE)",
            "amount": "CAST(floor(value) AS BIGINT)",
        },
    ),
    "requests": (
        "events",
        {"request_id": "event_id", "key": "'user' || CAST(user_id AS STRING)", "ts": "ts"},
    ),
    "existing_rules": (
        "part",
        {
            "id": "p_partkey",
            "name": "p_name",
            "language": _pick("p_partkey % 5", _LANG),
            "tool": _pick("p_partkey % 5", ["bandit", "eslint", "eslint", "gosec", "cargo-clippy"]),
            "rule_id": "'R' || CAST(p_partkey * 2 AS STRING)",
            "enabled": "p_size > 10",
            "severity_override": "CASE WHEN p_size > 40 THEN 'HIGH' ELSE NULL END",
            "custom_message": "CASE WHEN p_size > 30 THEN 'See ' || p_brand ELSE NULL END",
            "description": "p_type",
        },
    ),
    "incoming_rules": (
        "supplier",
        {
            "ord": "s_suppkey",
            "name": "s_name",
            "language": _pick("s_nationkey % 6", [*_LANG, "cobol"]),
            "tool": _pick("s_suppkey % 7", ["bandit", "eslint", "eslint", "gosec", "cargo-clippy", "cargo-audit", "lint"]),
            "rule_id": "'R' || CAST(s_suppkey * 3 AS STRING)",
            "enabled": "s_acctbal > 0",
            "severity_override": "CASE WHEN s_acctbal > 5000 THEN 'LOW' ELSE NULL END",
            "custom_message": "CAST(NULL AS STRING)",
            "description": "s_name",
        },
    ),
    "source_files": (
        "documents",
        {"file_path": "'doc/' || CAST(doc_id AS STRING)", "content": "text"},
    ),
    "manifest_new": (
        "documents",
        {"path": "'doc/' || CAST(doc_id AS STRING) || '.py'", "hash": "sha256(text)"},
    ),
    "deliveries": (
        "events",
        {
            "delivery_id": "event_id",
            "received_at": "ts",
            "event": "CASE event_type WHEN 'click' THEN 'pull_request' WHEN 'view' THEN 'pull_request' "
            "WHEN 'purchase' THEN 'push' WHEN 'error' THEN 'push' ELSE CASE user_id % 2 WHEN 0 THEN 'ping' "
            "ELSE 'issues' END END",
            "action": "CASE event_type WHEN 'click' THEN CASE user_id % 2 WHEN 0 THEN 'opened' ELSE 'synchronize' END "
            "ELSE 'closed' END",
            "ref": "CASE event_type WHEN 'purchase' THEN CASE user_id % 2 WHEN 0 THEN 'refs/heads/main' "
            "ELSE 'refs/heads/master' END ELSE 'refs/heads/topic' END",
            "number": "CAST(1 + event_id % 500 AS INT)",
            "sha": "'c' || CAST(event_id * 31 AS STRING)",
            "repo": "'org/repo' || CAST(user_id AS STRING)",
        },
    ),
}

# Hand-written views: the check's SQL here, the DataFrame form in ``Tables``.
SQL_VIEWS: dict[str, str] = {
    # Three findings in every source file, some of them past its last line.
    "located_findings": (
        "SELECT doc_id * 3 + k AS id, 'doc/' || CAST(doc_id AS VARCHAR) AS file_path, "
        "CAST(1 + (n_chars + 37 * k) % 40 AS INT) AS line_number "
        "FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)"
    ),
    # Labelled documents were there before (those marked toxic with other content), the
    # benchmark items were there and are gone.
    "manifest_old": (
        "SELECT 'doc/' || CAST(d.doc_id AS VARCHAR) || '.py' AS path, "
        "CASE WHEN l.toxic = 1 THEN sha256(d.text || '#') ELSE sha256(d.text) END AS hash "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id "
        "UNION ALL SELECT 'bench/' || CAST(item_id AS VARCHAR) || '.js', sha256(text) FROM benchmark"
    ),
    # Rules written against the findings' own tools.
    "finding_rules": (
        "SELECT * FROM (VALUES "
        "(1, 'bandit', 'B101', FALSE, NULL, NULL), "
        "(2, 'bandit', 'B303', TRUE, 'CRITICAL', 'Use a password hash'), "
        "(3, 'eslint', 'no-undef', FALSE, NULL, NULL), "
        "(4, 'gosec', 'G104', TRUE, 'LOW', NULL), "
        "(5, 'cargo-clippy', 'clippy::todo', NULL, NULL, 'Finish before release')"
        ") t(id, tool, rule_id, enabled, severity_override, custom_message)"
    ),
}


def with_views(sql: str, views: list[str]) -> str:
    """Prefix ``sql`` with the definitions of the views it reads."""
    parts = []
    for name in views:
        if name in SQL_VIEWS:
            body = SQL_VIEWS[name]
        else:
            source, columns = VIEWS[name]
            cols = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
            body = f"SELECT {cols} FROM {source}"
        parts.append(f"{name} AS ({body})")
    if not parts:
        return sql
    text = sql.strip()
    head = "WITH "
    if text.upper().startswith("WITH RECURSIVE "):
        head, text = "WITH RECURSIVE ", text[len("WITH RECURSIVE ") :]
        return head + ", ".join(parts) + ", " + text
    if text.upper().startswith("WITH "):
        return head + ", ".join(parts) + ", " + text[len("WITH ") :]
    return head + ", ".join(parts) + " " + text


def offline_completer(texts: list[str]) -> list[str | None]:
    """Deterministic stand-in for a model, for queries and tests: decides by words in the request."""
    answers: list[str | None] = []
    for text in texts:
        body = text.split("SAST Finding to Verify", 1)[-1].split("Your Task", 1)[0]
        if "Hardcoded password" in body:
            verdict = {"decision": "true_positive", "confidence": 0.95, "severity": "high"}
        elif "Graphic cache" in body:
            answers.append("no answer")
            continue
        elif "Unchecked buffer" in body:
            verdict = {"decision": "false_positive", "confidence": 0.8}
        else:
            verdict = {"decision": "uncertain", "confidence": 0.5}
        answers.append(json.dumps({**verdict, "reasoning": "Decided by a word in the request."}))
    return answers


class Tables:
    """The test tables of one folder and the views above, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # All times of the data model are naive UTC.
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW_DDL[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name == "located_findings":
            return (
                self.raw("documents")
                .select("doc_id", "n_chars", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
                .selectExpr(
                    "doc_id * 3 + k AS id",
                    "'doc/' || CAST(doc_id AS STRING) AS file_path",
                    "CAST(1 + (n_chars + 37 * k) % 40 AS INT) AS line_number",
                )
            )
        if name == "manifest_old":
            kept = (
                self.raw("documents")
                .join(self.raw("labels"), "doc_id")
                .selectExpr(
                    "'doc/' || CAST(doc_id AS STRING) || '.py' AS path",
                    "CASE WHEN toxic = 1 THEN sha2(text || '#', 256) ELSE sha2(text, 256) END AS hash",
                )
            )
            gone = self.raw("benchmark").selectExpr(
                "'bench/' || CAST(item_id AS STRING) || '.js' AS path", "sha2(text, 256) AS hash"
            )
            return kept.unionByName(gone)
        if name == "finding_rules":
            return self.spark.sql(SQL_VIEWS[name])
        source, columns = VIEWS[name]
        exprs = [f"{expr} AS {col}" for col, expr in columns.items()]
        return self.raw(source).selectExpr(*[e.replace("sha256(text)", "sha2(text, 256)") for e in exprs])

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in SQL_VIEWS:
            return self.view(name)
        return self.raw(name)
