"""Report readers: each query writes findings as a tool's report and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.plans.registry import oracle_sql, query
from triagelake.session import stored
from triagelake.sources import reports as rp

# Every finding becomes one report of one to three entries.
_ENTRIES = "e AS (SELECT f.*, unnest(range(1, 2 + f.id % 3)) AS i FROM findings f)"
_BASE = "CAST(id AS VARCHAR) AS report_id, i - 1 AS ord"


def _entries(make) -> Column:
    return F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("id") % 3), make)


def _reports(t, content: Column, tool: str = "") -> DataFrame:
    return t.findings.select(
        F.col("id").cast("string").alias("report_id"),
        F.lit(tool).alias("tool"),
        content.alias("content"),
        F.col("file_path"),
    )


_MAKERS = {}


def _report(name: str, sql: str, parse, columns: list[str], make):
    """Register a round trip of one tool."""
    _MAKERS[name] = make

    @query(name, f"WITH {_ENTRIES} SELECT {_BASE}, {sql} FROM e", "findings")
    def _(t):
        return parse(_reports(t, make())).select("report_id", "ord", *columns)


_CODE_COLS = ["rule_id", "severity", "confidence", "description", "file_path", "line_number", "code_snippet"]
_DEP_COLS = ["rule_id", "severity", "description", "file_path", "line_number", "cve", "package", "version", "fixed_version"]
_LINE = "CAST(line_number + i AS INT) AS line_number"


def _bandit() -> Column:
    return F.to_json(
        F.struct(
            _entries(
                lambda i: F.struct(
                    F.col("severity").alias("issue_severity"),
                    F.col("confidence").alias("issue_confidence"),
                    F.concat("description", F.lit(" #"), i.cast("string")).alias("issue_text"),
                    F.col("file_path").alias("filename"),
                    (F.col("line_number") + i).alias("line_number"),
                    F.col("code_snippet").alias("code"),
                    F.col("rule_id").alias("test_id"),
                )
            ).alias("results")
        )
    )


_report(
    "s01_bandit",
    "rule_id, severity, confidence, description || ' #' || CAST(i AS VARCHAR) AS description, file_path, "
    f"{_LINE}, code_snippet",
    rp.parse_bandit,
    _CODE_COLS,
    _bandit,
)


def _eslint() -> Column:
    """Two files per report; the second has one message without a rule."""
    message = lambda i: F.struct(
        F.when(i == 3, F.lit(None)).otherwise(F.col("rule_id")).alias("ruleId"),
        (1 + i % 2).cast("int").alias("severity"),
        F.col("description").alias("message"),
        (F.col("line_number") + i).alias("line"),
        F.when(i == 2, F.col("code_snippet")).alias("source"),
    )
    empty = F.filter(_entries(message), lambda m: F.lit(False))
    return F.to_json(
        F.array(
            F.struct(F.col("file_path").alias("filePath"), _entries(message).alias("messages")),
            F.struct(F.lit("other.js").alias("filePath"), empty.alias("messages")),
        )
    )


_ESLINT_SQL = (
    "rule_id, CASE WHEN 1 + i % 2 = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, '{conf}' AS confidence, description, "
    "file_path, " + _LINE + ", CASE WHEN i = 2 THEN code_snippet ELSE '' END AS code_snippet FROM e WHERE i <> 3"
)


@query(
    "s02_eslint",
    f"WITH {_ENTRIES} SELECT {_BASE}, " + _ESLINT_SQL.format(conf="High"),
    "findings",
)
def _(t):
    return rp.parse_eslint(_reports(t, _eslint())).select("report_id", "ord", *_CODE_COLS)


@query(
    "s03_eslint_typescript",
    f"WITH {_ENTRIES} SELECT {_BASE}, "
    + _ESLINT_SQL.format(conf="HIGH")
    + " AND (starts_with(rule_id, 'security/') OR starts_with(rule_id, 'no-unsanitized/') OR "
    "starts_with(rule_id, '@typescript-eslint/no-unsafe-') OR starts_with(rule_id, '@typescript-eslint/no-explicit-any') "
    "OR starts_with(rule_id, 'no-eval') OR starts_with(rule_id, 'no-implied-eval'))",
    "findings",
)
def _(t):
    return rp.parse_eslint_typescript(_reports(t, _eslint())).select("report_id", "ord", *_CODE_COLS)


_report(
    "s04_gosec",
    "rule_id, CASE WHEN i = 2 THEN 'MEDIUM' ELSE severity END AS severity, CASE WHEN i = 3 THEN 'HIGH' ELSE confidence END "
    f"AS confidence, description, file_path, {_LINE}, code_snippet",
    rp.parse_gosec,
    _CODE_COLS,
    lambda: F.to_json(
        F.struct(
            _entries(
                lambda i: F.struct(
                    F.when(i == 2, F.lit(None)).otherwise(F.lower("severity")).alias("severity"),
                    F.when(i == 3, F.lit(None)).otherwise(F.lower("confidence")).alias("confidence"),
                    F.col("description").alias("details"),
                    F.col("file_path").alias("file"),
                    F.when(i == 1, (F.col("line_number") + i).cast("string"))
                    .otherwise(F.concat((F.col("line_number") + i).cast("string"), F.lit("-99")))
                    .alias("line"),
                    F.col("code_snippet").alias("code"),
                    F.col("rule_id"),
                )
            ).alias("Issues")
        )
    ),
)


def _cargo() -> Column:
    return F.to_json(
        F.struct(
            F.struct(
                _entries(
                    lambda i: F.struct(
                        F.struct(
                            F.concat(F.lit("RUSTSEC-"), F.col("id").cast("string")).alias("id"),
                            F.when(i != 2, F.col("description")).alias("title"),
                            F.col("code_snippet").alias("description"),
                            F.when(i == 1, F.array(F.lit(">=1.2"), F.lit(">=2")))
                            .otherwise(F.array().cast("array<string>"))
                            .alias("patched_versions"),
                        ).alias("advisory"),
                        F.struct(
                            F.concat(F.lit("crate"), i.cast("string")).alias("name"),
                            F.concat(F.lit("0."), F.col("line_number").cast("string")).alias("version"),
                        ).alias("package"),
                    )
                ).alias("list")
            ).alias("vulnerabilities")
        )
    )


_report(
    "s05_cargo_audit",
    "'RUSTSEC-' || CAST(id AS VARCHAR) AS rule_id, 'HIGH' AS severity, 'HIGH' AS confidence, "
    "CASE WHEN i = 2 THEN 'Security vulnerability' ELSE description END || ' in crate' || CAST(i AS VARCHAR) || ' 0.' "
    "|| CAST(line_number AS VARCHAR) AS description, 'Cargo.lock' AS file_path, 0 AS line_number, code_snippet",
    rp.parse_cargo_audit,
    _CODE_COLS,
    _cargo,
)
_report(
    "s13_cargo_dependencies",
    "'RUSTSEC-' || CAST(id AS VARCHAR) AS rule_id, 'HIGH' AS severity, CASE WHEN i = 2 THEN 'Vulnerable Rust dependency' "
    "ELSE description END AS description, 'Cargo.toml' AS file_path, 1 AS line_number, 'RUSTSEC-' || CAST(id AS VARCHAR) "
    "AS cve, 'crate' || CAST(i AS VARCHAR) AS package, '0.' || CAST(line_number AS VARCHAR) AS version, "
    "CASE WHEN i = 1 THEN '>=1.2' END AS fixed_version",
    rp.parse_cargo_dependencies,
    _DEP_COLS,
    _cargo,
)


def _clippy() -> Column:
    """A line of another kind, a broken line, then one message per entry; the third has no spans."""
    line = lambda i: F.to_json(
        F.struct(
            F.lit("compiler-message").alias("reason"),
            F.struct(
                F.struct(F.col("rule_id").alias("code")).alias("code"),
                F.when(i == 1, F.lit("error")).otherwise(F.lit("warning")).alias("level"),
                F.col("description").alias("message"),
                F.when(i == 3, F.array().cast("array<struct<file_name:string,line_start:bigint,text:array<struct<text:string>>>>"))
                .otherwise(
                    F.array(
                        F.struct(
                            F.col("file_path").alias("file_name"),
                            (F.col("line_number") + i).alias("line_start"),
                            F.array(F.struct(F.col("code_snippet").alias("text"))).alias("text"),
                        )
                    )
                )
                .alias("spans"),
            ).alias("message"),
        )
    )
    head = F.array(F.lit('{"reason": "build-finished"}'), F.lit("not json"))
    return F.array_join(F.concat(head, _entries(line)), "\n")


@query(
    "s06_cargo_clippy",
    f"WITH {_ENTRIES} SELECT CAST(id AS VARCHAR) AS report_id, i + 1 AS ord, rule_id, "
    "CASE WHEN i = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'HIGH' AS confidence, description, file_path, "
    f"{_LINE}, code_snippet FROM e WHERE i <> 3 AND rule_id IN ('clippy::unwrap_used', 'clippy::panic', 'clippy::todo')",
    "findings",
)
def _(t):
    return rp.parse_clippy(_reports(t, _clippy())).select("report_id", "ord", *_CODE_COLS)


def _attr(name: str, value: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit(f' {name}="'), escaped, F.lit('"'))


def _cppcheck() -> Column:
    """Every fourth report is cut off in the middle."""
    entry = lambda i: F.concat(
        F.lit("<error"),
        _attr("id", F.col("rule_id")),
        F.when(i == 1, F.lit(' severity="error"')).when(i == 2, F.lit(' severity="information"')).otherwise(F.lit("")),
        _attr("msg", F.col("description")),
        F.when(i == 1, _attr("verbose", F.concat("description", F.lit(" & more")))).otherwise(F.lit("")),
        F.lit(">"),
        F.when(
            i != 3,
            F.concat(
                F.lit("<location"),
                _attr("file", F.col("file_path")),
                _attr("line", (F.col("line_number") + i).cast("string")),
                F.lit('/><location file="second.c" line="1"/>'),
            ),
        ).otherwise(F.lit("")),
        F.lit("</error>"),
    )
    whole = F.concat(
        F.lit('<?xml version="1.0"?><results version="2"><errors>'),
        F.array_join(_entries(entry), ""),
        F.lit("</errors></results>"),
    )
    return F.when(F.col("id") % 4 == 3, F.expr("'<results version=\"2\"><errors>'")).otherwise(whole)


@query(
    "s07_cppcheck",
    f"WITH {_ENTRIES} SELECT {_BASE}, rule_id, CASE WHEN i = 1 THEN 'HIGH' WHEN i = 2 THEN 'INFO' ELSE 'LOW' END AS severity, "
    "CASE WHEN i = 1 THEN description || ' & more' ELSE description END AS description, "
    "CASE WHEN i = 3 THEN 'unknown' ELSE file_path END AS file_path, CAST(CASE WHEN i = 3 THEN 1 ELSE line_number + i END AS INT) "
    "AS line_number FROM e WHERE id % 4 <> 3 UNION ALL SELECT CAST(id AS VARCHAR), 0, 'PARSE_ERROR', 'ERROR', "
    "'Failed to parse cppcheck output', 'unknown', 1 FROM findings WHERE id % 4 = 3",
    "findings",
)
def _(t):
    out = rp.parse_cppcheck(_reports(t, _cppcheck()))
    return out.select("report_id", "ord", "rule_id", "severity", "description", "file_path", "line_number")


def _clang_tidy() -> Column:
    line = lambda i: F.concat(
        F.lit("a.c:"),
        F.when(i == 3, F.lit("x")).otherwise((F.col("line_number") + i).cast("string")),
        F.when(i == 1, F.lit(":7: error: ")).otherwise(F.lit(":7: warning: ")),
        F.col("description"),
        F.when(i == 1, F.concat(F.lit(" [cert-"), F.col("rule_id"), F.lit("]"))).otherwise(F.lit("")),
    )
    return F.concat(F.lit("3 warnings generated.\n"), F.array_join(_entries(line), "\n"))


@query(
    "s08_clang_tidy",
    f"WITH {_ENTRIES} SELECT CAST(id AS VARCHAR) AS report_id, i AS ord, CASE WHEN i = 1 THEN 'cert-' || rule_id ELSE "
    "'clang-tidy' END AS rule_id, CASE WHEN i = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN i = 1 THEN 'error: ' "
    f"ELSE 'warning: ' END || description AS description, file_path, {_LINE} FROM e WHERE i <> 3",
    "findings",
)
def _(t):
    out = rp.parse_clang_tidy(_reports(t, _clang_tidy()))
    return out.select("report_id", "ord", "rule_id", "severity", "description", "file_path", "line_number")


def _spotbugs() -> Column:
    entry = lambda i: F.concat(
        F.lit("<BugInstance"),
        _attr("type", F.col("rule_id")),
        F.when(i != 2, _attr("category", F.lit("SECURITY"))).otherwise(F.lit("")),
        _attr("priority", i.cast("string")),
        F.lit(">"),
        F.when(i != 3, F.concat(F.lit("<LongMessage>"), F.col("description"), F.lit("</LongMessage>"))).otherwise(F.lit("")),
        F.when(
            i == 1,
            F.concat(F.lit("<Class><SourceLine"), _attr("sourcepath", F.col("file_path")), F.lit(' start="3"/></Class>')),
        ).otherwise(F.lit("")),
        F.when(
            i != 3,
            F.concat(
                F.lit("<SourceLine"),
                _attr("sourcepath", F.col("file_path")),
                _attr("start", (F.col("line_number") + i).cast("string")),
                F.lit("/>"),
            ),
        ).otherwise(F.lit("")),
        F.lit("</BugInstance>"),
    )
    return F.concat(F.lit("<BugCollection>"), F.array_join(_entries(entry), ""), F.lit("</BugCollection>"))


_report(
    "s09_spotbugs",
    "rule_id, CASE i WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN i = 3 THEN rule_id ELSE "
    "description END AS description, CASE WHEN i = 3 THEN 'unknown' ELSE file_path END AS file_path, "
    "CAST(CASE i WHEN 1 THEN 3 WHEN 2 THEN line_number + 2 ELSE 1 END AS INT) AS line_number, "
    "CASE WHEN i = 2 THEN 'UNKNOWN' ELSE 'SECURITY' END AS category",
    rp.parse_spotbugs,
    ["rule_id", "severity", "description", "file_path", "line_number", "category"],
    _spotbugs,
)

_report(
    "s10_pip_audit",
    "'PYSEC-' || CAST(id AS VARCHAR) AS rule_id, CASE WHEN i = 2 THEN 'MEDIUM' WHEN severity IN ('CRITICAL', 'HIGH') THEN 'HIGH' "
    "WHEN severity = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'Vulnerable dependency: pkg' || CAST(i AS VARCHAR) || "
    "' 1.' || CAST(line_number AS VARCHAR) AS description, 'requirements.txt' AS file_path, 1 AS line_number, "
    "'PYSEC-' || CAST(id AS VARCHAR) AS cve, 'pkg' || CAST(i AS VARCHAR) AS package, '1.' || CAST(line_number AS VARCHAR) AS version, "
    "CASE WHEN i = 1 THEN '2.0' END AS fixed_version",
    rp.parse_pip_audit,
    _DEP_COLS,
    lambda: F.to_json(
        F.struct(
            _entries(
                lambda i: F.struct(
                    F.concat(F.lit("PYSEC-"), F.col("id").cast("string")).alias("id"),
                    F.concat(F.lit("pkg"), i.cast("string")).alias("name"),
                    F.concat(F.lit("1."), F.col("line_number").cast("string")).alias("version"),
                    F.when(i != 2, F.lower("severity")).alias("severity"),
                    F.when(i == 1, F.array(F.lit("2.0"), F.lit("3.0")))
                    .otherwise(F.array().cast("array<string>"))
                    .alias("fix_versions"),
                )
            ).alias("vulnerabilities")
        )
    ),
)


def _npm() -> Column:
    """Package 2 has a text ``via`` and a boolean ``fixAvailable``."""
    record = lambda i: F.concat(
        F.lit('"pkg'),
        i.cast("string"),
        F.lit('": {"severity": "'),
        F.when(i == 2, F.lit("moderate")).otherwise(F.lower("severity")),
        F.lit('", "via": ['),
        F.when(i == 2, F.lit('"pkg1"')).otherwise(F.concat(F.lit('{"cve": "CVE-'), F.col("id").cast("string"), F.lit('"}'))),
        F.lit(']'),
        F.when(i != 3, F.lit(', "range": "<2.1"')).otherwise(F.lit("")),
        F.lit(', "fixAvailable": '),
        F.when(i == 1, F.lit('{"version": "2.1"}')).otherwise(F.lit("true")),
        F.lit("}"),
    )
    return F.concat(F.lit('{"vulnerabilities": {'), F.array_join(_entries(record), ", "), F.lit("}}"))


_report(
    "s11_npm_audit",
    "'NPM-' || CASE WHEN i = 2 THEN 'UNKNOWN' ELSE 'CVE-' || CAST(id AS VARCHAR) END AS rule_id, CASE WHEN i = 2 THEN 'MODERATE' "
    "ELSE severity END AS severity, 'Vulnerable dependency: pkg' || CAST(i AS VARCHAR) AS description, 'package.json' AS file_path, "
    "1 AS line_number, CASE WHEN i <> 2 THEN 'CVE-' || CAST(id AS VARCHAR) END AS cve, 'pkg' || CAST(i AS VARCHAR) AS package, "
    "CASE WHEN i = 3 THEN 'unknown' ELSE '<2.1' END AS version, CASE WHEN i = 1 THEN '2.1' END AS fixed_version",
    rp.parse_npm_audit,
    _DEP_COLS,
    _npm,
)


def _govulncheck() -> Column:
    line = lambda i: F.when(i == 2, F.lit('{"progress": {"message": "scanning"}}')).otherwise(
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.lit("GO-"), F.col("id").cast("string")).alias("osv"),
                    F.when(i == 1, F.col("description")).alias("description"),
                    F.col("file_path").alias("module"),
                    F.lit("v1.0").alias("found"),
                    F.when(i == 3, F.lit("v1.1")).alias("fixed"),
                ).alias("finding")
            )
        )
    )
    return F.concat(F.lit("{cut\n\n"), F.array_join(_entries(line), "\n"))


@query(
    "s12_govulncheck",
    f"WITH {_ENTRIES} SELECT CAST(id AS VARCHAR) AS report_id, i + 1 AS ord, 'GO-' || CAST(id AS VARCHAR) AS rule_id, 'HIGH' AS severity, "
    "CASE WHEN i = 1 THEN description ELSE 'Vulnerable Go dependency' END AS description, 'go.mod' AS file_path, 1 AS line_number, "
    "'GO-' || CAST(id AS VARCHAR) AS cve, file_path AS package, 'v1.0' AS version, CASE WHEN i = 3 THEN 'v1.1' END AS fixed_version "
    "FROM e WHERE i <> 2",
    "findings",
)
def _(t):
    return rp.parse_govulncheck(_reports(t, _govulncheck())).select("report_id", "ord", *_DEP_COLS)


_report(
    "s14_dependency_check",
    "'CVE-' || CAST(id AS VARCHAR) AS rule_id, CASE WHEN i = 2 THEN 'MEDIUM' ELSE severity END AS severity, CASE WHEN i = 3 THEN "
    "'Vulnerable Java dependency' ELSE description END AS description, 'pom.xml' AS file_path, 1 AS line_number, "
    "'CVE-' || CAST(id AS VARCHAR) AS cve, 'lib.jar' AS package, 'unknown' AS version, CAST(NULL AS VARCHAR) AS fixed_version",
    rp.parse_dependency_check,
    _DEP_COLS,
    lambda: F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("lib.jar").alias("fileName"),
                    _entries(
                        lambda i: F.struct(
                            F.concat(F.lit("CVE-"), F.col("id").cast("string")).alias("name"),
                            F.when(i != 2, F.col("severity")).alias("severity"),
                            F.when(i != 3, F.col("description")).alias("description"),
                        )
                    ).alias("vulnerabilities"),
                )
            ).alias("dependencies")
        )
    ),
)


@query(
    "s15_failed_runs",
    "SELECT CAST(id AS VARCHAR) AS report_id, CASE language WHEN 'python' THEN 'javac' WHEN 'go' THEN 'gradle' ELSE 'maven' END "
    "AS tool, CASE status WHEN 'failed' THEN 'BUILD_ERROR' WHEN 'pending' THEN 'TIMEOUT' ELSE 'SCAN_ERROR' END AS rule_id, "
    "'ERROR' AS severity, 'Build of ' || repo_full_name || ' failed' AS description, repo_full_name AS file_path, 1 AS line_number "
    "FROM scan_jobs WHERE status <> 'completed'",
    "scan_jobs",
)
def _(t):
    runs = t.scan_jobs.select(
        F.col("id").alias("report_id"),
        F.expr("CASE language WHEN 'python' THEN 'javac' WHEN 'go' THEN 'gradle' ELSE 'maven' END").alias("tool"),
        F.expr(
            "CASE status WHEN 'failed' THEN 'BUILD_ERROR' WHEN 'pending' THEN 'TIMEOUT' WHEN 'running' THEN 'SCAN_ERROR' END"
        ).alias("code"),
        F.concat(F.lit("Build of "), "repo_full_name", F.lit(" failed")).alias("message"),
        F.col("repo_full_name").alias("file_path"),
    )
    out = rp.failure_rows(runs)
    return out.select("report_id", "tool", "rule_id", "severity", "description", "file_path", "line_number")


# Tool of a report, the query that reads the same reports alone, and what makes them.
_MAKERS |= {
    "s02_eslint": _eslint,
    "s03_eslint_typescript": _eslint,
    "s06_cargo_clippy": _clippy,
    "s07_cppcheck": _cppcheck,
    "s08_clang_tidy": _clang_tidy,
    "s12_govulncheck": _govulncheck,
}
_DISPATCH = {
    "bandit": "s01_bandit",
    "eslint": "s02_eslint",
    "eslint-typescript": "s03_eslint_typescript",
    "gosec": "s04_gosec",
    "cargo-audit": "s05_cargo_audit",
    "cargo-clippy": "s06_cargo_clippy",
    "cppcheck": "s07_cppcheck",
    "clang-tidy": "s08_clang_tidy",
    "spotbugs": "s09_spotbugs",
    "pip-audit": "s10_pip_audit",
    "npm-audit": "s11_npm_audit",
    "govulncheck": "s12_govulncheck",
    "cargo-dependencies": "s13_cargo_dependencies",
    "dependency-check": "s14_dependency_check",
}
_FROM_ALL = [
    f"SELECT report_id, ord, '{tool.replace('cargo-dependencies', 'cargo-audit')}' AS tool, rule_id, severity, description, file_path, line_number "
    f"FROM ({oracle_sql()[name]}) t{i} WHERE CAST(report_id AS BIGINT) % 15 = {i}"
    for i, (tool, name) in enumerate(_DISPATCH.items())
]


@query(
    "s21_parser_dispatch",
    " UNION ALL ".join(_FROM_ALL) + " UNION ALL SELECT CAST(id AS VARCHAR), 0, 'scanner_registry', 'UNSUPPORTED_LANGUAGE', 'ERROR', "
    "'No scanner available for file: ' || file_path, file_path, 1 FROM findings WHERE id % 15 = 14",
    "findings",
)
def _(t):
    """Reports of all 14 tools and of an unknown one, dealt over the findings, in one pass."""
    which = F.col("id") % 15
    tool, content = F.lit("fortran-lint"), F.lit("")
    for i, (name, source) in enumerate(_DISPATCH.items()):
        tool = F.when(which == i, name).otherwise(tool)
        content = F.when(which == i, _MAKERS[source]()).otherwise(content)
    raw = t.findings.select(F.col("id").cast("string").alias("report_id"), tool.alias("tool"), content.alias("content"), "file_path")
    found = rp.parse_reports(stored(raw, "raw-reports"))
    return found.select("report_id", "ord", "tool", "rule_id", "severity", "description", "file_path", "line_number")


@query(
    "p01_common_projection",
    f"WITH {_ENTRIES} SELECT tool, rule_id, severity, package, count(*) AS n FROM ("
    "SELECT 'bandit' AS tool, rule_id, severity, CAST(NULL AS VARCHAR) AS package FROM e UNION ALL "
    "SELECT 'dependency-check', 'CVE', 'MEDIUM', 'lib' FROM findings) z GROUP BY 1, 2, 3, 4",
    "findings",
)
def _(t):
    deps = F.lit('{"dependencies":[{"fileName":"lib","vulnerabilities":[{"name":"CVE"}]}]}')
    both = rp.parse_bandit(_reports(t, _bandit())).unionByName(rp.parse_dependency_check(_reports(t, deps)))
    return both.groupBy("tool", "rule_id", "severity", "package").agg(F.count("*").alias("n"))
