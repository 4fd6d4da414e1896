"""Readers of tool reports: one column expression per tool, their registry, and parsers made of them.

Input rows hold one report each: ``report_id``, ``content`` and optionally ``file_path``
(the scanned file). Output rows are findings in the shape of ``REPORT_FINDING_DDL``, with
``ord`` numbering the entries of a report. A JSON report that cannot be parsed yields no
rows, a broken XML report yields one ``PARSE_ERROR`` row, and bad lines of line-based
reports are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import severity as sev
from triagelake.schemas import REPORT_FINDING_DDL

#: From a report's content and scanned file to the array of its findings.
Reader = Callable[[Column, Column], Column]
Parser = Callable[[DataFrame], DataFrame]

_SHAPE = [tuple(column.split(" ")) for column in REPORT_FINDING_DDL.split(", ")]

# Fixed values.
TYPESCRIPT_RULE_PREFIXES = [
    "security/",
    "no-unsanitized/",
    "@typescript-eslint/no-unsafe-",
    "@typescript-eslint/no-explicit-any",
    "no-eval",
    "no-implied-eval",
]
CLIPPY_LINTS = [
    "clippy::unwrap_used",
    "clippy::expect_used",
    "clippy::panic",
    "clippy::unimplemented",
    "clippy::todo",
    "clippy::unreachable",
    "clippy::mem_forget",
    "clippy::cast_ptr_alignment",
    "clippy::transmute_ptr_to_ptr",
]
FAILURE_CODES = ["TIMEOUT", "SCAN_ERROR", "COMPILATION_ERROR", "BUILD_ERROR", "PARSE_ERROR", "UNSUPPORTED_LANGUAGE"]


def _shape(df: DataFrame, **values: Column | str | int) -> DataFrame:
    """Select the finding columns; what is not given is null."""
    cols = [F.col("report_id").cast("string").alias("report_id"), F.col("ord").cast("long").alias("ord")]
    for name, kind in _SHAPE[2:]:
        v = values.get(name)
        c = v if isinstance(v, Column) else F.lit(v)
        cols.append(c.cast(kind).alias(name))
    return df.select(*cols)


_FINDINGS = "array<struct<ord:bigint," + ",".join(f"{name}:{kind}" for name, kind in _SHAPE[2:]) + ">>"


def _finding(position: Column, **values: Column | str | int) -> Column:
    """One finding as a struct; what is not given is null."""
    cols = [position.cast("long").alias("ord")]
    for name, kind in _SHAPE[2:]:
        v = values.get(name)
        c = v if isinstance(v, Column) else F.lit(v)
        cols.append(c.cast(kind).alias(name))
    return F.struct(*cols)


def _json(text: Column, ddl: str) -> Column:
    return F.from_json(text, ddl, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _nested(outer: Column, inner: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """Findings ``make(o, e, ord)`` of the entries ``e`` inside each element ``o``, numbered by both positions."""
    none = F.array().cast(_FINDINGS)

    def of(o: Column, i: Column) -> Column:
        first = F.shiftleft(i.cast("long"), 32)
        return F.coalesce(F.transform(inner(o), lambda e, j: make(o, e, first + j)), none)

    return F.flatten(F.transform(outer, of))


def _bandit(content: Column, path: Column) -> Column:
    parsed = _json(
        content,
        "results array<struct<issue_severity:string,issue_confidence:string,issue_text:string,"
        "filename:string,line_number:int,code:string,test_id:string>>",
    )
    return F.transform(
        parsed["results"],
        lambda e, i: _finding(
            i,
            tool="bandit",
            rule_id=e["test_id"],
            severity=e["issue_severity"],
            confidence=e["issue_confidence"],
            description=e["issue_text"],
            file_path=e["filename"],
            line_number=e["line_number"],
            code_snippet=e["code"],
        ),
    )


def _eslint_findings(content: Column, tool: str, confidence: str) -> Column:
    files = _json(
        content,
        "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,"
        "message:string,line:int,source:string>>>>",
    )
    found = _nested(
        files,
        lambda f: f["messages"],
        lambda f, e, position: _finding(
            position,
            tool=tool,
            rule_id=e["ruleId"],
            severity=F.when(e["severity"] == 2, "HIGH").otherwise("MEDIUM"),
            confidence=confidence,
            description=e["message"],
            file_path=_or(f["filePath"], ""),
            line_number=e["line"],
            code_snippet=_or(e["source"], ""),
        ),
    )
    return F.filter(found, lambda x: x["rule_id"] != "")


def _eslint(content: Column, path: Column) -> Column:
    return _eslint_findings(content, "eslint", "High")


def _eslint_typescript(content: Column, path: Column) -> Column:
    """As ESLint, security rules only."""
    secure = lambda x: reduce(lambda a, b: a | b, [x["rule_id"].startswith(p) for p in TYPESCRIPT_RULE_PREFIXES])
    return F.filter(_eslint_findings(content, "eslint-typescript", "HIGH"), secure)


def _gosec(content: Column, path: Column) -> Column:
    parsed = _json(
        content,
        "Issues array<struct<severity:string,confidence:string,details:string,file:string,"
        "line:string,code:string,rule_id:string>>",
    )
    return F.transform(
        parsed["Issues"],
        lambda e, i: _finding(
            i,
            tool="gosec",
            rule_id=_or(e["rule_id"], ""),
            severity=F.upper(_or(e["severity"], "MEDIUM")),
            confidence=F.upper(_or(e["confidence"], "HIGH")),
            description=_or(e["details"], ""),
            file_path=_or(e["file"], ""),
            line_number=_or(F.regexp_extract(e["line"], r"^\s*([0-9]+)", 1).try_cast("int"), 0),
            code_snippet=_or(e["code"], ""),
        ),
    )


def _cargo_entries(content: Column) -> Column:
    parsed = _json(
        content,
        "vulnerabilities struct<list:array<struct<advisory:struct<id:string,title:string,"
        "description:string,patched_versions:array<string>>,package:struct<name:string,version:string>>>>",
    )
    return parsed["vulnerabilities"]["list"]


def _cargo_audit(content: Column, path: Column) -> Column:
    """cargo-audit advisories as code findings."""
    return F.transform(
        _cargo_entries(content),
        lambda e, i: _finding(
            i,
            tool="cargo-audit",
            rule_id=_or(e["advisory"]["id"], ""),
            severity="HIGH",
            confidence="HIGH",
            description=F.concat(
                _or(e["advisory"]["title"], "Security vulnerability"),
                F.lit(" in "),
                _or(e["package"]["name"], "unknown"),
                F.lit(" "),
                _or(e["package"]["version"], ""),
            ),
            file_path="Cargo.lock",
            line_number=0,
            code_snippet=_or(e["advisory"]["description"], ""),
        ),
    )


def _cargo_dependencies(content: Column, path: Column) -> Column:
    """cargo-audit advisories as dependency findings."""
    return F.transform(
        _cargo_entries(content),
        lambda e, i: _finding(
            i,
            tool="cargo-audit",
            rule_id=_or(e["advisory"]["id"], "UNKNOWN"),
            severity="HIGH",
            description=_or(e["advisory"]["title"], "Vulnerable Rust dependency"),
            file_path="Cargo.toml",
            line_number=1,
            cve=e["advisory"]["id"],
            package=e["package"]["name"],
            version=e["package"]["version"],
            fixed_version=F.try_element_at(e["advisory"]["patched_versions"], F.lit(1)),
        ),
    )


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _json_lines(content: Column, ddl: str, holds: Callable[[Column], Column]) -> Column:
    """``(ord, line, e)`` of each line that may matter; a line that is no JSON object gives null fields.

    ``holds`` tells from a line's text whether it has words without which it cannot become a finding. Only such
    lines are parsed, and lines with an escape like ``\\u0063``, which may spell the words in another way.
    """
    # A split at one character costs much less than one at a pattern.
    unix = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(F.when(content.contains("\r"), unix).otherwise(content), "\n")

    def parsed(line: Column, i: Column) -> Column:
        row = F.struct(i.alias("ord"), line.alias("line"), _json(line, ddl).alias("e"))
        return F.when(holds(line) | line.contains("\\u"), row)

    return F.filter(F.transform(lines, parsed), lambda x: x.isNotNull())


def _clippy(content: Column, path: Column) -> Column:
    rows = _json_lines(
        content,
        "reason string, message struct<code:struct<code:string>,level:string,message:string,"
        "spans:array<struct<file_name:string,line_start:int,text:array<struct<text:string>>>>>",
        # What all lints begin with is looked for first: one search settles most other lines.
        lambda line: line.contains(commonprefix(CLIPPY_LINTS)) & line.contains("compiler-message") & _any(line, CLIPPY_LINTS),
    )
    code = lambda x: _or(x["e"]["message"]["code"]["code"], "")
    span = lambda x: F.try_element_at(x["e"]["message"]["spans"], F.lit(1))
    lint = lambda x: _any(code(x), CLIPPY_LINTS)
    kept = F.filter(rows, lambda x: (x["e"]["reason"] == "compiler-message") & lint(x) & span(x).isNotNull())
    return F.transform(
        kept,
        lambda x: _finding(
            x["ord"],
            tool="cargo-clippy",
            rule_id=code(x),
            severity=F.when(x["e"]["message"]["level"] == "error", "HIGH").otherwise("MEDIUM"),
            confidence="HIGH",
            description=_or(x["e"]["message"]["message"], ""),
            file_path=_or(span(x)["file_name"], ""),
            line_number=_or(span(x)["line_start"], 0),
            code_snippet=_or(F.try_element_at(span(x)["text"], F.lit(1))["text"], ""),
        ),
    )


def _xml_findings(
    content: Column, tool: str, ddl: str, pick: Callable[[Column], Column], make: Callable[[Column, Column], Column]
) -> Column:
    """Parse ``content`` as XML once; a report that is no well-formed XML gives one PARSE_ERROR finding."""
    text = F.coalesce(content, F.lit(""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "attributePrefix": "_"}
    failed = _finding(
        F.lit(0),
        tool=tool,
        rule_id="PARSE_ERROR",
        severity="ERROR",
        description=f"Failed to parse {tool} output",
        file_path="unknown",
        line_number=1,
    )

    def of(x: Column) -> Column:
        broken = x.isNull() | x["_bad"].isNotNull() | (F.trim(text) == "")
        return F.when(broken, F.array(failed)).otherwise(F.transform(pick(x), make))

    # An array of one binds the parsed report, which is used more than once.
    return F.flatten(F.transform(F.array(F.from_xml(text, f"{ddl}, _bad string", options)), of))


def _cppcheck(content: Column, path: Column) -> Column:
    error = (
        "struct<_id:string,_severity:string,_msg:string,_verbose:string,"
        "location:array<struct<_file:string,_line:string>>>"
    )
    none = F.array().cast(f"array<{error}>")
    place = lambda e: F.try_element_at(e["location"], F.lit(1))
    return _xml_findings(
        content,
        "cppcheck",
        f"errors struct<error:array<{error}>>, error array<{error}>",
        lambda x: F.concat(F.coalesce(x["errors"]["error"], none), F.coalesce(x["error"], none)),
        lambda e, i: _finding(
            i,
            tool="cppcheck",
            rule_id=_or(e["_id"], "UNKNOWN"),
            severity=sev.lookup(_or(e["_severity"], "style"), sev.CPPCHECK_SEVERITY, "MEDIUM"),
            description=F.coalesce(e["_verbose"], e["_msg"], F.lit("No description")),
            file_path=_or(place(e)["_file"], "unknown"),
            line_number=_or(place(e)["_line"].try_cast("int"), 1),
        ),
    )


def _spotbugs(content: Column, path: Column) -> Column:
    """The class element comes first in a bug, so its source line is the first of the bug."""
    line = "array<struct<_sourcepath:string,_start:string>>"
    bug = (
        "struct<_type:string,_category:string,_priority:string,LongMessage:string,"
        f"Class:array<struct<SourceLine:{line}>>,Method:array<struct<SourceLine:{line}>>,"
        f"Field:array<struct<SourceLine:{line}>>,SourceLine:{line}>"
    )
    one = F.lit(1)

    def place(e: Column) -> Column:
        parts = [F.try_element_at(e[part], one)["SourceLine"] for part in ("Class", "Method", "Field")]
        return F.coalesce(*[F.try_element_at(p, one) for p in [*parts, e["SourceLine"]]])

    return _xml_findings(
        content,
        "spotbugs",
        f"BugInstance array<{bug}>",
        lambda x: F.coalesce(x["BugInstance"], F.array().cast(f"array<{bug}>")),
        lambda e, i: _finding(
            i,
            tool="spotbugs",
            rule_id=_or(e["_type"], "UNKNOWN"),
            severity=sev.lookup(e["_priority"], sev.SPOTBUGS_PRIORITY, "LOW"),
            description=F.coalesce(e["LongMessage"], e["_type"], F.lit("UNKNOWN")),
            file_path=_or(place(e)["_sourcepath"], "unknown"),
            line_number=_or(place(e)["_start"].try_cast("int"), 1),
            category=_or(e["_category"], "UNKNOWN"),
        ),
    )


def _clang_tidy(content: Column, path: Column) -> Column:
    """Lines ``file:line:col: warning: message [check]``; the file is the scanned file."""

    def parts(line: Column, i: Column) -> Column:
        cut = F.split(line, ":")
        return F.struct(
            i.alias("ord"),
            line.contains(": error:").alias("error"),
            (line.contains(": warning:") | line.contains(": error:")).alias("told"),
            F.get(cut, F.lit(1)).alias("number"),
            F.array_join(F.slice(cut, F.lit(4), F.size(cut)), ":").alias("message"),
            F.size(cut).alias("n"),
        )

    def number(x: Column) -> Column:
        return F.trim(x["number"]).try_cast("int")

    def make(x: Column) -> Column:
        message = x["message"]
        tagged = message.contains("[") & message.contains("]")
        tail = F.substring_index(message, "[", -1)
        head = F.left(message, F.length(message) - F.length(tail) - 1)
        check = F.when(tail.contains("]"), F.regexp_extract(tail, r"(?s)^(.*)\]", 1)).otherwise("")
        return _finding(
            x["ord"],
            tool="clang-tidy",
            rule_id=F.when(tagged, check).otherwise("clang-tidy"),
            severity=F.when(x["error"], "HIGH").otherwise("MEDIUM"),
            description=F.regexp_replace(F.when(tagged, head).otherwise(message), r"^\s+|\s+$", ""),
            file_path=path,
            line_number=number(x),
        )

    lines = F.transform(F.split(content, "\n"), parts)
    kept = F.filter(lines, lambda x: x["told"] & (x["n"] >= 4) & number(x).isNotNull())
    return F.transform(kept, make)


def _pip_audit(content: Column, path: Column) -> Column:
    parsed = _json(
        content,
        "vulnerabilities array<struct<id:string,name:string,version:string,severity:string,fix_versions:array<string>>>",
    )
    return F.transform(
        parsed["vulnerabilities"],
        lambda e, i: _finding(
            i,
            tool="pip-audit",
            rule_id=_or(e["id"], "UNKNOWN"),
            severity=sev.dependency_severity(_or(e["severity"], "MEDIUM")),
            description=F.concat_ws(
                " ", F.lit("Vulnerable dependency:"), _or(e["name"], "None"), _or(e["version"], "None")
            ),
            file_path="requirements.txt",
            line_number=1,
            cve=e["id"],
            package=e["name"],
            version=e["version"],
            fixed_version=F.try_element_at(e["fix_versions"], F.lit(1)),
        ),
    )


def _npm_audit(content: Column, path: Column) -> Column:
    """Records keep their JSON text, so ``via`` may hold strings and ``fixAvailable`` a boolean."""
    records = F.map_entries(_json(content, "vulnerabilities map<string,string>")["vulnerabilities"])

    def make(e: Column, i: Column) -> Column:
        field = lambda at: F.get_json_object(e["value"], at)
        return _finding(
            i,
            tool="npm-audit",
            rule_id=F.concat(F.lit("NPM-"), _or(field("$.via[0].cve"), "UNKNOWN")),
            severity=F.upper(_or(field("$.severity"), "medium")),
            description=F.concat(F.lit("Vulnerable dependency: "), e["key"]),
            file_path="package.json",
            line_number=1,
            cve=field("$.via[0].cve"),
            package=e["key"],
            version=_or(field("$.range"), "unknown"),
            fixed_version=field("$.fixAvailable.version"),
        )

    return F.transform(records, make)


def _govulncheck(content: Column, path: Column) -> Column:
    rows = _json_lines(
        content,
        "finding struct<osv:string,description:string,module:string,found:string,fixed:string>",
        lambda line: line.contains('"finding"'),
    )
    told = lambda x: x["e"]["finding"].isNotNull() & (F.get_json_object(x["line"], "$.finding") != "{}")
    return F.transform(
        F.filter(rows, told),
        lambda x: _finding(
            x["ord"],
            tool="govulncheck",
            rule_id=_or(x["e"]["finding"]["osv"], "UNKNOWN"),
            severity="HIGH",
            description=_or(x["e"]["finding"]["description"], "Vulnerable Go dependency"),
            file_path="go.mod",
            line_number=1,
            cve=x["e"]["finding"]["osv"],
            package=x["e"]["finding"]["module"],
            version=x["e"]["finding"]["found"],
            fixed_version=x["e"]["finding"]["fixed"],
        ),
    )


def _dependency_check(content: Column, path: Column) -> Column:
    parsed = _json(
        content,
        "dependencies array<struct<fileName:string,vulnerabilities:array<struct<name:string,"
        "severity:string,description:string>>>>",
    )
    return _nested(
        parsed["dependencies"],
        lambda d: d["vulnerabilities"],
        lambda d, e, position: _finding(
            position,
            tool="dependency-check",
            rule_id=_or(e["name"], "UNKNOWN"),
            severity=_or(e["severity"], "MEDIUM"),
            description=_or(e["description"], "Vulnerable Java dependency"),
            file_path="pom.xml",
            line_number=1,
            cve=e["name"],
            package=d["fileName"],
            version="unknown",
        ),
    )


def _read(reports: DataFrame, pick: Callable[[Column, Column], Column]) -> DataFrame:
    scanned = F.col("file_path") if "file_path" in reports.columns else F.lit("unknown")
    return reports.select(F.col("report_id").cast("string").alias("report_id"), F.inline(pick(F.col("content"), scanned)))


def _parser(reader: Reader) -> Parser:
    def parse(reports: DataFrame) -> DataFrame:
        return _read(reports, reader)

    parse.__doc__ = reader.__doc__
    return parse


parse_bandit = _parser(_bandit)
parse_eslint = _parser(_eslint)
parse_eslint_typescript = _parser(_eslint_typescript)
parse_gosec = _parser(_gosec)
parse_cargo_audit = _parser(_cargo_audit)
parse_clippy = _parser(_clippy)
parse_cppcheck = _parser(_cppcheck)
parse_clang_tidy = _parser(_clang_tidy)
parse_spotbugs = _parser(_spotbugs)
parse_pip_audit = _parser(_pip_audit)
parse_npm_audit = _parser(_npm_audit)
parse_govulncheck = _parser(_govulncheck)
parse_cargo_dependencies = _parser(_cargo_dependencies)
parse_dependency_check = _parser(_dependency_check)


def failure_rows(runs: DataFrame) -> DataFrame:
    """Runs that failed outright ``(report_id, tool, file_path, code, message)`` as ERROR findings."""
    return _shape(
        runs.where(F.col("code").isin(FAILURE_CODES)).withColumn("ord", F.lit(0)),
        tool=F.col("tool"),
        rule_id=F.col("code"),
        severity="ERROR",
        description=F.col("message"),
        file_path=_or(F.col("file_path"), "unknown"),
        line_number=1,
    )


def _unsupported(path: Column) -> Column:
    return _finding(
        F.lit(0),
        tool="scanner_registry",
        rule_id="UNSUPPORTED_LANGUAGE",
        severity="ERROR",
        description=F.concat(F.lit("No scanner available for file: "), _or(path, "unknown")),
        file_path=_or(path, "unknown"),
        line_number=1,
    )


def unsupported_files(files: DataFrame) -> DataFrame:
    """One ERROR finding per file no scanner covers (``report_id``, ``file_path``)."""
    found = F.array(_unsupported(F.col("file_path")))
    return files.select(F.col("report_id").cast("string").alias("report_id"), F.inline(found))


READERS: dict[str, Reader] = {
    "bandit": _bandit,
    "eslint": _eslint,
    "eslint-typescript": _eslint_typescript,
    "gosec": _gosec,
    "cargo-audit": _cargo_audit,
    "cargo-clippy": _clippy,
    "cppcheck": _cppcheck,
    "clang-tidy": _clang_tidy,
    "spotbugs": _spotbugs,
    "pip-audit": _pip_audit,
    "npm-audit": _npm_audit,
    "govulncheck": _govulncheck,
    "cargo-dependencies": _cargo_dependencies,
    "dependency-check": _dependency_check,
}

#: Parsers plugged in for tools that have no reader here, or instead of it.
PARSERS: dict[str, Parser] = {}

LANGUAGE_TOOLS = {
    "python": ["bandit"],
    "javascript": ["eslint"],
    "typescript": ["eslint-typescript"],
    "go": ["gosec"],
    "rust": ["cargo-audit", "cargo-clippy"],
    "java": ["spotbugs"],
    "cpp": ["cppcheck", "clang-tidy"],
}


def register_parser(tool: str, parser: Parser) -> None:
    """Plug in a reader for another tool; it must return ``REPORT_FINDING_DDL`` columns."""
    PARSERS[tool] = parser


def parser_for(tool: str) -> Parser:
    if tool in PARSERS:
        return PARSERS[tool]
    if tool not in READERS:
        raise ValueError(f"no parser for tool: {tool}")
    return _parser(READERS[tool])


def tools_for_language(language: str) -> list[str]:
    if language.lower() not in LANGUAGE_TOOLS:
        raise ValueError(f"unsupported language: {language}")
    return LANGUAGE_TOOLS[language.lower()]


def parse_reports(raw: DataFrame, tools: list[str] | None = None, report_unknown: bool = True) -> DataFrame:
    """Findings of a table of raw reports ``(report_id, tool, content, file_path)``, of all tools in one pass.

    Each row is read by the reader of its tool alone, so the table is scanned once and every report is parsed
    once. Tools with a plugged-in parser have a pass of their own, since that may be any query. Reports of tools
    without a parser become one ERROR row each unless ``report_unknown`` is off; reports of tools that are known but not among
    ``tools`` are left out. (A variant would parse before the tool is known, but holds reports of limited size only.)
    """
    wanted = list(READERS | PARSERS) if tools is None else tools
    parts = [parser_for(t)(raw.where(F.col("tool") == t)) for t in wanted if t in PARSERS or t not in READERS]
    here = [t for t in wanted if t in READERS and t not in PARSERS]

    def of_its_tool(content: Column, path: Column) -> Column:
        found = F.array().cast(_FINDINGS)
        if report_unknown:
            unknown = ~F.col("tool").isin(list(READERS | PARSERS))
            found = F.when(unknown, F.array(_unsupported(path))).otherwise(found)
        for tool in here:
            found = F.when(F.col("tool") == tool, READERS[tool](content, path)).otherwise(found)
        return found

    if here or report_unknown:
        parts.insert(0, _read(raw, of_its_tool))
    return reduce(DataFrame.unionByName, parts)


def write_raw_reports(raw: DataFrame, path: str) -> None:
    """Store raw reports with one folder per tool."""
    raw.write.mode("append").partitionBy("tool").parquet(path)


def read_reports(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Report files of one tool, one row per file, ready for :func:`parse_reports`."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("report_id"),
        F.lit(tool).alias("tool"),
        F.col("value").alias("content"),
        F.lit(None).cast("string").alias("file_path"),
    )


def read_json_line_reports(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Line-based reports, one row per line, so that a large report is split across tasks."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("report_id"),
        F.lit(tool).alias("tool"),
        F.col("value").alias("content"),
        F.lit(None).cast("string").alias("file_path"),
    )
