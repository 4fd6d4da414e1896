"""Report readers on hand-made reports, bad input included."""

import json

import pytest
from pyspark.sql import functions as F

from triagelake.sources import reports as rp


@pytest.fixture()
def read(table):
    def run(tool, content, file_path="scanned.c"):
        raw = table([("r1", content, file_path)], "report_id string, content string, file_path string")
        return [r.asDict() for r in rp.parser_for(tool)(raw).orderBy("ord").collect()]

    return run


JSON_TOOLS = [
    "bandit", "eslint", "eslint-typescript", "gosec", "cargo-audit", "cargo-clippy", "pip-audit", "npm-audit",
    "govulncheck", "cargo-dependencies", "dependency-check",
]


@pytest.mark.parametrize("tool", JSON_TOOLS)
@pytest.mark.parametrize("content", ["", "{cut", "[]", "{}", "null", None])
def test_bad_json_gives_no_rows(read, tool, content):
    assert read(tool, content) == []


@pytest.mark.parametrize("tool", ["cppcheck", "spotbugs"])
@pytest.mark.parametrize("content", ["", "<a><b>", "plain text", None])
def test_bad_xml_gives_one_error_row(read, tool, content):
    (row,) = read(tool, content)
    assert (row["rule_id"], row["severity"], row["file_path"], row["line_number"]) == ("PARSE_ERROR", "ERROR", "unknown", 1)
    assert row["tool"] == tool


def test_bandit_missing_fields_are_null(read):
    rows = read("bandit", json.dumps({"results": [{"test_id": "B1"}, {"test_id": "B2", "line_number": 4, "issue_text": "ü"}]}))
    assert [r["rule_id"] for r in rows] == ["B1", "B2"]
    assert rows[0]["severity"] is None and rows[0]["line_number"] is None
    assert rows[1]["description"] == "ü"


def test_eslint_drops_messages_without_rule(read):
    report = [
        {"filePath": "a.js", "messages": [
            {"ruleId": None, "severity": 2}, {"ruleId": "", "severity": 2},
            {"ruleId": "no-eval", "severity": 2, "message": "m", "line": 3},
            {"ruleId": "semi", "severity": 1, "line": 4, "source": "x"},
        ]},
        {"filePath": "b.js", "messages": []},
    ]
    rows = read("eslint", json.dumps(report))
    assert [(r["rule_id"], r["severity"], r["confidence"], r["code_snippet"]) for r in rows] == [
        ("no-eval", "HIGH", "High", ""), ("semi", "MEDIUM", "High", "x"),
    ]
    rows = read("eslint-typescript", json.dumps(report))
    assert [(r["rule_id"], r["tool"], r["confidence"]) for r in rows] == [("no-eval", "eslint-typescript", "HIGH")]


def test_gosec_lines_and_defaults(read):
    rows = read("gosec", '{"Issues": [{"line": "12-14", "severity": "low"}, {"line": 7}, {"rule_id": "G1"}, {"line": "x"}]}')
    assert [r["line_number"] for r in rows] == [12, 7, 0, 0]
    assert [r["severity"] for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "MEDIUM"]
    assert {r["confidence"] for r in rows} == {"HIGH"}


def _clippy_line(code="clippy::panic", reason="compiler-message", line=4):
    message = {"code": {"code": code}, "level": "error", "message": "boom", "spans": [{"file_name": "s.rs", "line_start": line}]}
    return json.dumps({"reason": reason, "message": message})


@pytest.mark.parametrize(
    ("tool", "found", "others"),
    [
        ("cargo-clippy", _clippy_line(), [
            "not json", '{"reason": "build-finished"}', _clippy_line("unused_variables"), _clippy_line("clippy::needless_return"),
            _clippy_line(reason="compiler-artifact"),
        ]),
        ("govulncheck", '{"finding": {"osv": "GO-1"}}', ["{cut", '{"progress": {"message": "a finding"}}', '{"osv": {"id": "GO-2"}}']),
    ],
)
def test_only_lines_that_may_be_findings_are_parsed(read, monkeypatch, tool, found, others):
    plain = rp._json
    strict = lambda text, ddl: F.when(text == found, plain(text, ddl)).otherwise(F.raise_error(text))
    monkeypatch.setattr(rp, "_json", strict)
    assert [r["ord"] for r in read(tool, "\n".join([*others, found, "", *others, found]))] == [len(others), 2 * len(others) + 2]


def test_words_spelt_with_escapes_are_found(read):
    plain = _clippy_line()
    lines = [plain, plain.replace("clippy", "\\u0063lippy"), plain.replace("compiler", "\\u0063ompiler"), plain.replace("panic", "\\u0070ANIC")]
    rows = read("cargo-clippy", "\n".join(lines))
    assert [(r["ord"], r["rule_id"]) for r in rows] == [(0, "clippy::panic"), (1, "clippy::panic"), (2, "clippy::panic")]
    (row,) = read("govulncheck", '{"\\u0066inding": {"osv": "GO-1"}}')
    assert row["rule_id"] == "GO-1"


def test_lines_end_as_on_any_system(read):
    one = _clippy_line()
    # Line feeds, returns, both, and empty lines between them.
    report = one + "\n" + one + "\r" + one + "\r\n" + one + "\n\r" + one + "\r\r\n" + one + "\r\n\r\n" + one + "\r"
    assert [r["ord"] for r in read("cargo-clippy", report)] == [0, 1, 2, 3, 5, 7, 9]


def test_clippy_null_code_and_empty_spans(read):
    lines = [
        {"reason": "compiler-message", "message": {"code": None, "spans": [{"file_name": "a.rs"}]}},
        {"reason": "compiler-message", "message": {"code": {"code": "clippy::todo"}, "spans": []}},
        {"reason": "compiler-artifact"},
        {"reason": "compiler-message", "message": {
            "code": {"code": "clippy::panic"}, "level": "error", "message": "boom",
            "spans": [{"file_name": "s.rs", "line_start": 4, "text": [{"text": "panic!()"}]}, {"file_name": "z.rs"}]}},
        {"reason": "compiler-message", "message": {
            "code": {"code": "clippy::unwrap_used"}, "spans": [{"file_name": "t.rs", "line_start": 9}]}},
    ]
    rows = read("cargo-clippy", "\n".join(["garbage", *[json.dumps(x) for x in lines], ""]))
    assert [(r["rule_id"], r["severity"], r["file_path"], r["line_number"], r["code_snippet"]) for r in rows] == [
        ("clippy::panic", "HIGH", "s.rs", 4, "panic!()"), ("clippy::unwrap_used", "MEDIUM", "t.rs", 9, ""),
    ]


def test_cppcheck_defaults(read):
    xml = (
        '<results version="2"><errors><error id="a" severity="error" msg="m" verbose="v &lt; w"><location file="x.c" line="7"/>'
        '<location file="y.c" line="8"/></error><error severity="odd"/><error id="c" msg="only"/></errors></results>'
    )
    rows = read("cppcheck", xml)
    assert [(r["rule_id"], r["severity"], r["description"], r["file_path"], r["line_number"]) for r in rows] == [
        ("a", "HIGH", "v < w", "x.c", 7),
        ("UNKNOWN", "MEDIUM", "No description", "unknown", 1),
        ("c", "LOW", "only", "unknown", 1),
    ]


def test_spotbugs_first_source_line(read):
    xml = (
        '<BugCollection><BugInstance type="T" category="SECURITY" priority="1"><LongMessage>long</LongMessage>'
        '<Class><SourceLine sourcepath="A.java" start="3"/></Class><SourceLine sourcepath="B.java" start="9"/></BugInstance>'
        '<BugInstance type="U" priority="7"><SourceLine sourcepath="C.java" start="5"/></BugInstance></BugCollection>'
    )
    rows = read("spotbugs", xml)
    assert [(r["rule_id"], r["severity"], r["description"], r["file_path"], r["line_number"], r["category"]) for r in rows] == [
        ("T", "HIGH", "long", "A.java", 3, "SECURITY"), ("U", "LOW", "U", "C.java", 5, "UNKNOWN"),
    ]


def test_clang_tidy_lines(read):
    text = "a.c:12:3: warning: use of [x] bad [cert-err]\nnote\nb.c:x:1: error: y\nc.c:3:1: error: plain\nd.c:4:1: warning: ]odd["
    rows = read("clang-tidy", text)
    assert [(r["line_number"], r["severity"], r["rule_id"], r["description"], r["file_path"]) for r in rows] == [
        (12, "MEDIUM", "cert-err", "warning: use of [x] bad", "scanned.c"),
        (3, "HIGH", "clang-tidy", "error: plain", "scanned.c"),
        (4, "MEDIUM", "", "warning: ]odd", "scanned.c"),
    ]


def test_npm_text_via_and_boolean_fix(read):
    report = {"vulnerabilities": {
        "a": {"severity": "moderate", "via": ["b"], "fixAvailable": True},
        "c": {"via": [{"cve": "CVE-1"}], "range": "<2", "fixAvailable": {"version": "2.0"}},
    }}
    rows = {r["package"]: r for r in read("npm-audit", json.dumps(report))}
    assert (rows["a"]["severity"], rows["a"]["rule_id"], rows["a"]["version"], rows["a"]["fixed_version"]) == (
        "MODERATE", "NPM-UNKNOWN", "unknown", None)
    assert (rows["c"]["severity"], rows["c"]["rule_id"], rows["c"]["cve"], rows["c"]["fixed_version"]) == (
        "MEDIUM", "NPM-CVE-1", "CVE-1", "2.0")


def test_pip_audit_empty_fix_versions(read):
    rows = read("pip-audit", '{"vulnerabilities": [{"id": "P1", "name": "n", "version": "1", "severity": "critical", "fix_versions": []}, {"id": "P2"}]}')
    assert [(r["severity"], r["fixed_version"], r["description"]) for r in rows] == [
        ("HIGH", None, "Vulnerable dependency: n 1"), ("MEDIUM", None, "Vulnerable dependency: None None"),
    ]


def test_dispatch_and_plug_in(spark, table):
    def parse_custom(reports):
        from pyspark.sql import functions as F

        return rp._shape(reports.withColumn("ord", F.lit(0)), tool="mine", rule_id=F.col("content"))

    rp.register_parser("mine", parse_custom)
    try:
        raw = table(
            [("1", "mine", "X1", None), ("2", "alien", "?", "f.zz"), ("3", "bandit", '{"results":[{"test_id":"B1"}]}', None)],
            "report_id string, tool string, content string, file_path string",
        )
        got = {(r["tool"], r["rule_id"]) for r in rp.parse_reports(raw).collect()}
    finally:
        del rp.PARSERS["mine"]
    assert got == {("mine", "X1"), ("scanner_registry", "UNSUPPORTED_LANGUAGE"), ("bandit", "B1")}
    with pytest.raises(ValueError):
        rp.parser_for("alien")
    with pytest.raises(ValueError):
        rp.tools_for_language("cobol")
    assert rp.tools_for_language("Rust") == ["cargo-audit", "cargo-clippy"]


def test_all_tools_in_one_pass(spark, tmp_path):
    """The same findings as tool by tool, with one scan of the table and no shuffle."""
    contents = [
        ("bandit", '{"results":[{"test_id":"B1"},{"test_id":"B2"}]}'),
        ("eslint", '[{"filePath":"a.js"},{"filePath":"b.js","messages":[{"ruleId":"semi"},null,{"ruleId":"no-eval"}]}]'),
        ("eslint-typescript", '[{"filePath":"b.ts","messages":[{"ruleId":"semi"},{"ruleId":"no-eval"}]}]'),
        ("gosec", '{"Issues":[{"rule_id":"G1"}]}'),
        ("cargo-audit", '{"vulnerabilities":{"list":[{"advisory":{"id":"R1"}}]}}'),
        ("cargo-dependencies", '{"vulnerabilities":{"list":[{"advisory":{"id":"R2"}}]}}'),
        ("cppcheck", "<results>"),
        ("spotbugs", '<BugCollection><BugInstance type="T"/></BugCollection>'),
        ("clang-tidy", "a.c:1:2: error: x [c]"),
        ("npm-audit", '{"vulnerabilities":{"p":{}}}'),
        ("alien", "?"),
        (None, "{}"),
        ("bandit", None),
    ]
    rows = [(str(i), tool, content, "f") for i, (tool, content) in enumerate(contents)]
    spark.createDataFrame(rows, "report_id string, tool string, content string, file_path string").write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    got = rp.parse_reports(raw)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    alone = [rp.parser_for(t)(raw.where(raw.tool == t)).collect() for t in rp.READERS]
    alone = [r for rows in alone for r in rows] + rp.unsupported_files(raw.where("tool = 'alien'")).collect()
    assert sorted(map(str, got.collect())) == sorted(map(str, alone))
    assert [(r.report_id, r.ord, r.rule_id) for r in got.where("tool = 'eslint'").orderBy("ord").collect()] == [
        ("1", 1 << 32, "semi"), ("1", (1 << 32) + 2, "no-eval"),
    ]
    assert rp.parse_reports(raw, ["gosec"], report_unknown=False).count() == 1
    assert rp.parse_reports(raw.limit(0)).count() == 0


def test_read_report_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"results":[\n{"test_id":"B1"}\n]}')
    (tmp_path / "two.json").write_text("{broken")
    got = rp.parse_reports(rp.read_reports(spark, str(tmp_path), "bandit"), ["bandit"]).collect()
    assert [r["rule_id"] for r in got] == ["B1"]


def test_failure_rows(table):
    runs = table(
        [("1", "maven", "pom.xml", "BUILD_ERROR", "boom"), ("2", "x", None, "FINE", "")],
        "report_id string, tool string, file_path string, code string, message string",
    )
    (row,) = rp.failure_rows(runs).collect()
    assert (row["rule_id"], row["severity"], row["line_number"], row["description"]) == ("BUILD_ERROR", "ERROR", 1, "boom")
