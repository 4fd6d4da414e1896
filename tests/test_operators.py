"""Operators against plain Python on small inputs, hot keys included."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagelake.functions import languages, severity
from triagelake.functions.symbols import symbol_spans
from triagelake.operators import (
    cache, compliance, context, costs, feedback, findings, fixes, incremental, metrics, ordered, review, rules, throttle,
)
from triagelake.plans.proxies import offline_completer
from triagelake.sources import deliveries, tree

T0 = datetime(2024, 1, 1)


# ------------------------------------------------------- ordered helpers


@pytest.fixture(scope="module")
def hot(table):
    """Two thirds of the rows on one key."""
    rng = random.Random(1)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.randint(-3, 5), rng.choice([None, f"v{i}"])))
    return rows, table(rows, "i long, k string, n int, v string")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 7, 100, 10000])
def test_running_and_carried_values(hot, size):
    rows, df = hot
    chunk = F.floor(F.col("i") / size)
    total = {r.i: r.s for r in ordered.running_sum(df, ["k"], ["i"], chunk, F.col("n"), "s").collect()}
    number = {r.i: r.s for r in ordered.running_number(df, ["k"], ["i"], chunk, "s").collect()}
    carried = {r.i: r.s for r in ordered.carry_forward(df, ["k"], ["i"], chunk, "v", "s").collect()}
    assert len(total) == len(rows)
    for group in by_key(rows).values():
        s, last = 0, None
        for pos, (i, _, n, v) in enumerate(group, 1):
            s, last = s + n, v if v is not None else last
            assert (total[i], number[i], carried[i]) == (s, pos, last)


def test_running_sum_without_key(hot):
    rows, df = hot
    got = {r.i: r.s for r in ordered.running_sum(df, [], ["i"], F.floor(F.col("i") / 50), F.col("n"), "s").collect()}
    s = 0
    for i, _, n, _ in rows:
        s += n
        assert got[i] == s


def test_one_shuffle_of_the_rows(spark, hot):
    _, df = hot
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered.running_number(df, ["k"], ["i"], F.floor(F.col("i") / 50), "s")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    on_rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(__k" in line]
    assert len(on_rows) == 2  # the rows, and the summary that meets them


def test_first_n_prunes_before_the_shuffle(hot):
    _, df = hot
    plan = ordered.first_n(df, ["k"], [F.col("i")], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# --------------------------------------------------------------- metrics


def test_ratios(table):
    df = table([(8, 2, 2), (0, 0, 5), (0, 3, 0), (0, 0, 0)], "true_positives long, false_positives long, false_negatives long")
    got = [(r.precision, r.recall, r.f1_score) for r in metrics.with_scores(df).collect()]
    assert got[0] == pytest.approx((0.8, 0.8, 0.8))
    assert got[1] == (None, 0.0, None)
    assert got[2] == (0.0, None, None)
    assert got[3] == (None, None, None)
    with pytest.raises(ValueError):
        metrics.period_bucket("hourly")


def test_feedback_on_one_hot_finding(table):
    fb = table(
        [(i, 1 if i < 90 else 2, ["true_positive", "false_positive"][i % 2], T0) for i in range(100)],
        "id long, finding_id long, feedback_type string, created_at timestamp",
    )
    fd = table(
        [(1, 10, "go", "gosec", "G1", "HIGH"), (2, 11, "go", "gosec", "G2", "LOW"), (3, 12, "go", "gosec", "G3", "LOW")],
        "id long, scan_job_id long, language string, tool string, rule_id string, severity string",
    )
    judged = metrics.judged_findings(fb, fd)
    assert judged.count() == 2
    row = metrics.scores_by(judged, ["language"]).first()
    assert (row.true_positives, row.false_positives, row.total_findings, row.total_scans) == (50, 50, 2, 2)
    empty = feedback.stats(fb.limit(0)).first()
    assert (empty.total_feedback, empty.false_positive_rate) == (0, 0.0)
    with pytest.raises(ValueError):
        feedback.recent(fb, 101)


def test_histogram_quantile(table):
    rows = [(T0, "a", v) for v in [0.02] * 50 + [0.3] * 49 + [99.0]] + [(T0, "b", 50.0)]
    df = table(rows, "ts timestamp, l string, v double")
    got = {r.l: r.quantile for r in metrics.histogram_quantile(df, 0.95, ["l"], "v").collect()}
    assert got["a"] == pytest.approx(0.25 + 0.25 * (95 - 50) / 49)
    assert got["b"] == 10.0


# ----------------------------------------------------------------- rules


def test_rule_changes(table):
    ddl = "id long, name string, language string, tool string, rule_id string, enabled boolean, severity_override string, custom_message string, description string"
    have = table([(1, "a", "go", "gosec", "G1", True, "LOW", "m", "d"), (2, "b", "go", "gosec", "G2", True, None, None, "d")], ddl)
    patch = table(
        [(1, ["severity_override", "enabled"], False, None, "x", "x", T0)],
        "id long, fields array<string>, enabled boolean, severity_override string, custom_message string, description string, updated_at timestamp",
    )
    one, two = rules.update_rules(have, patch).orderBy("id").collect()
    assert (one.enabled, one.severity_override, one.custom_message) == (False, None, "m")
    assert (two.enabled, two.description) == (True, "d")
    new = table(
        [(0, "n", "go", "gosec", "G1"), (1, "n", "go", "gosec", "G9"), (2, "n", "go", "gosec", "G9"), (3, "n", "ada", "gosec", "G8"), (4, "n", "go", "lint", "G8")],
        "ord long, name string, language string, tool string, rule_id string",
    )
    reasons = [r.reason for r in rules.check_new_rules(new, have).orderBy("ord").collect()]
    assert reasons == ["Rule gosec:G1 already exists", None, None, "invalid language", "invalid tool"]
    assert rules.check_import(new, have).where("error IS NULL").count() == 4
    assert rules.check_import(new, have, dedupe_batch=True).where("error IS NULL").count() == 3
    summary = rules.import_summary(rules.check_import(new, have)).first()
    assert (summary.imported, summary.failed, summary.errors) == (4, 1, ["Rule gosec:G1 already exists"])
    with pytest.raises(ValueError):
        rules.page(have, -1, 10)


def test_import_summary_keeps_first_ten_errors(table):
    many = table([(i, f"e{i:03d}") for i in range(50)], "ord long, error string")
    row = rules.import_summary(many).first()
    assert (row.imported, row.failed, row.errors) == (0, 50, [f"e{i:03d}" for i in range(10)])


def test_gate(table):
    df = table([("Low",), (None,), ("odd",)], "severity string")
    assert [severity.exit_code(df, t).first()[0] for t in ("low", "medium", "none", "?")] == [1, 0, 0, 0]
    assert severity.exit_code(df.limit(0), "low").first()[0] == 0


# ----------------------------------------------------------------- costs


def test_prices_and_unknown_provider(table):
    calls = table(
        [("openai", "gpt-4", 1000, 1000), ("openai", "new", 1000, 0), ("acme", "x", 1, 1)],
        "provider string, model string, input_tokens long, output_tokens long",
    )
    got = {(r.provider, r.model): r.cost_usd for r in costs.with_cost(calls).collect()}
    assert got[("openai", "gpt-4")] == pytest.approx(0.09)
    assert got[("openai", "new")] == pytest.approx(0.0025)
    assert got[("acme", "x")] is None
    assert costs.cost_by(calls.limit(0), []).first().cost_usd == 0.0


def test_default_cost_range(table):
    rows = table([(datetime(2024, 5, 1),), (datetime(2024, 4, 30, 23, 59, 59),), (datetime(2024, 5, 9),)], "timestamp timestamp")
    assert costs.in_range(rows, now=datetime(2024, 5, 3)).count() == 1


# ------------------------------------------------------------ compliance


def test_compliance_choice_and_empty(table):
    ddl = "p string, id long, rule_id string, description string, severity string"
    df = table([("p", 1, None, None, "CRITICAL"), ("p", 2, "auth-1", "monkey business", "HIGH")], ddl)
    row = compliance.summary(df, "soc2", "p").first()
    assert (row.security_findings, row.confidentiality_findings, row.compliance_score, row.status) == (1, 1, 85, "COMPLIANT")
    assert compliance.summary(df, "HIPAA", "p").first().access_control_status == "FAIL"
    none = compliance.summary(df.limit(0), "gdpr").first()
    assert (none.compliance_score, none.status, none.recommendations) == (100, "COMPLIANT", [])
    with pytest.raises(ValueError):
        compliance.standard("PCI-DSS")


@pytest.mark.parametrize("kind", ["SOC2", "GDPR", "HIPAA"])
def test_compliance_documents(table, kind):
    import json

    df = table(
        [("p", i, "r", "personal secret key phi log tls auth", "HIGH", "f", 1, "t") for i in range(15)],
        "p string, id long, rule_id string, description string, severity string, file_path string, line_number int, tool string",
    )
    doc = json.loads(compliance.report(df, kind, "p", ["id"]).first().report)
    assert doc["report_type"] == kind and doc["project_name"] == "p" and doc["version"] == "1.0"
    if kind == "SOC2":
        assert doc["principles"]["privacy"]["findings_count"] == 15
        assert len(doc["principles"]["privacy"]["findings"]) == 10
    if kind == "HIPAA":
        assert doc["safeguards"]["technical"] == {"encryption": "FAIL", "access_control": "PASS"}


# --------------------------------------------------------------- context

PY = "import os\nfrom a import b\n\nclass Box:\n    def get(self):\n        x = 1\n\n        return x\n\n    async def put(self):\n        def inner():\n            return 2\n        return inner\n\ntop = 1\n"
JS = "import x from 'y';\nfunction f(a) {\n  if (a) {\n    eval(a); // }\n  }\n}\nclass C {\n  m() {\n    return `}`;\n  }\n}\nconst g = (a) => {\n  return a;\n};\n"


def test_contexts_by_language(table):
    files = table(
        [("a.py", PY, "python"), ("b.js", JS, "javascript"), ("c.go", "package main\nfunc f() {}\n", "go"), ("bad.py", "def (:\n  x", "python")],
        "file_path string, content string, language string",
    )
    places = [
        ("a.py", 6), ("a.py", 7), ("a.py", 4), ("a.py", 12), ("a.py", 13), ("a.py", 15),
        ("b.js", 4), ("b.js", 9), ("b.js", 7), ("b.js", 13), ("c.go", 2), ("bad.py", 1), ("gone.py", 1),
    ]
    found = table([(i, f, n) for i, (f, n) in enumerate(places)], "id long, file_path string, line_number int")
    got = {r.id: r.context for r in context.attach_context(found, files).collect()}
    names = {i: (c.context_type, c.function_name, c.class_name) if c else None for i, c in got.items()}
    line = ("line_based_fallback", None, None)
    assert [names[i] for i in range(len(places))] == [
        ("function", "get", "Box"), ("function", "get", "Box"), ("class", None, "Box"), ("function", "inner", "Box"),
        ("function", "put", "Box"), line, ("function", "f", None), ("function", "m", "C"), ("class", None, "C"),
        ("function", None, None), line, line, None,
    ]
    assert got[3].context_code == "def inner():\n            return 2"
    assert got[0].imports == ["import os", "from a import b"] and got[6].imports == ["import x from 'y';"]
    assert (got[0].context_start_line, got[0].context_end_line) == (5, 8)


def test_line_windows_like_python(table):
    text = "\n".join(f"l{i}" for i in range(1, 301))
    files = table([("f", text), ("e", "")], "file_path string, content string")
    rows = [(i, "f", n) for i, n in enumerate([1, 5, 11, 63, 64, 65, 128, 129, 290, 300, 305])] + [(99, "e", 1), (98, "x", 1)]
    found = table(rows, "id long, file_path string, line_number int")
    got = {r.id: r for r in context.line_context(found, files).collect()}
    lines = text.split("\n")
    for i, f, n in rows:
        if f == "f":
            start, end = max(0, n - 11), min(len(lines), n + 10)
            assert (got[i].context_code, got[i].context_start_line, got[i].context_end_line) == ("\n".join(lines[start:end]), start + 1, end)
    assert got[99].context_code == "" and got[98].context_code is None


# ------------------------------------------------- trees, changes, routes


def test_tree_listing(spark, tmp_path):
    import hashlib

    for name, text in {"src/a.py": "x = 1", "src/b.js": "y", "node_modules/c.py": "z", ".github/d.py": "w", ".git/e.py": "v", "venv/f.py": "u"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "__init__.py").write_text("")
    (tmp_path / "src/big.py").write_text("x" * 100)
    shown = {"src/a.py": hashlib.sha256(b"x = 1").hexdigest()}
    hidden = {".github/d.py": hashlib.sha256(b"w").hexdigest(), "__init__.py": hashlib.sha256(b"").hexdigest()}
    files = tree.read_tree(spark, str(tmp_path), 50)
    assert {r.path: r.hash for r in tree.list_files(files, [".py"]).collect()} == shown
    files = tree.walk_tree(spark, str(tmp_path), 50)
    assert {r.path: r.hash for r in tree.list_files(files, [".py"]).collect()} == {**shown, **hidden}
    files = tree.walk_tree(spark, tmp_path.as_uri(), 50)
    assert {r.path: r.hash for r in tree.list_files(files, [".py"]).collect()} == {**shown, **hidden}


def test_deep_and_wide_trees_are_listed(spark, tmp_path, monkeypatch):
    """A deep path, many folders, one of many files, empty folders and files, odd names, links that lead round."""
    import os

    names = {f"wide/d{i}/_f.py": i for i in range(40)}
    names |= {f"full/{i}.c": 1 for i in range(120)}
    names |= {"a/" * 12 + "deep.go": 3, "x y/ü#%.js": 2, ".hidden/_y": 0}
    for name, size in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    (tmp_path / "src/node_modules/p").mkdir(parents=True)
    (tmp_path / "src/node_modules/p/q.js").write_text("z")
    (tmp_path / "none").mkdir()
    os.symlink(tmp_path, tmp_path / "wide/round")
    os.symlink(tmp_path / "full/1.c", tmp_path / "wide/link.c")
    names["wide/link.c"] = 1
    monkeypatch.setattr(tree, "FOLDERS_PER_TASK", 3)
    monkeypatch.setattr(tree, "FILES_PER_TASK", 10)
    monkeypatch.setattr(tree, "LISTED_AT_ONCE", 7)
    assert {r.path: r.length for r in tree.list_tree(spark, str(tmp_path)).collect()} == names
    files = tree.walk_tree(spark, str(tmp_path), 20)
    assert files.rdd.getNumPartitions() > 10
    assert {r.path: len(r.content) for r in files.collect()} == {k: v for k, v in names.items() if v <= 20}
    assert tree.walk_tree(spark, str(tmp_path / "none")).collect() == []
    assert tree.list_tree(spark, str(tmp_path / "missing")).collect() == []


def test_changed_files(table):
    ddl = "path string, hash string"
    new = table([("a.py", "1"), ("b.py", "2"), ("c.js", "3")], ddl)
    old = table([("a.py", "1"), ("b.py", "9"), ("d.py", "4")], ddl)
    assert [r.path for r in incremental.changed_files(new, old).orderBy("path").collect()] == ["b.py", "c.js"]
    assert [r.path for r in incremental.changed_files(new, None, [".py"]).orderBy("path").collect()] == ["a.py", "b.py"]
    status = {r.path: r.status for r in incremental.compare_manifests(new, old).collect()}
    assert status == {"a.py": "same", "b.py": "changed", "c.js": "new", "d.py": "deleted"}


def test_routes_with_bad_body(table):
    df = table(
        [(1, "pull_request", "{cut"), (2, "push", '{"ref": "refs/heads/main", "after": "s", "repository": {"full_name": "o/r"}}'), (3, "ping", "{}"), (4, "fork", "{}")],
        "delivery_id long, event string, body string",
    )
    got = {r.delivery_id: (r.queued, r.message) for r in deliveries.route(deliveries.parse(df)).collect()}
    assert got == {1: (False, "PR action None ignored"), 2: (True, "Scan queued"), 3: (False, "pong"), 4: (False, "Event fork not handled")}


def test_pr_files_substring_quirks(table):
    fd = table([(1, 7, "src/ba.py"), (2, 7, "src/c.go"), (3, 8, "src/ba.py"), (4, 9, "q")], "id long, scan_job_id long, file_path string")
    pr = table([(7, "a.py"), (7, "zz"), (9, "")], "scan_job_id long, file_name string")
    assert sorted(r.id for r in findings.in_pr_files(fd, pr).collect()) == [1, 4]


def test_pr_files_by_rarest_gram(table):
    """A hot job: the index tests few of its paths x files pairs and finds what testing all finds."""
    rng = random.Random(8)
    folders = ["src/main/java", "src/test", "lib", "tools/build"]
    paths = [f"{rng.choice(folders)}/module{rng.randrange(400)}/File{i}.java" for i in range(1500)]
    names = [p.split("/", 1)[1] for p in rng.sample(paths, 150)] + [f"module{k}/" for k in range(20)] + [f"gone{k}.py" for k in range(300)] + ["9.j", "é/ü", "lib/module7/", "src/"]
    rows = [(i, 7, p) for i, p in enumerate(paths)] + [(5000, 8, "a/b.py"), (5001, 8, None), (5002, 7, None), (5003, 7, "é/ü.py"), (5004, 9, "x")]
    pr = [(7, n) for n in names] + [(8, "a/b.py"), (8, None), (10, "")]
    fd = table(rows, "id long, scan_job_id long, file_path string")
    files = table(pr, "scan_job_id long, file_name string")
    want = {i for i, j, p in rows if any(k == j and n is not None and n in (p or "") for k, n in pr)}
    for tested in (1 << 20, 1000):
        assert {r.id for r in findings.in_pr_files(fd, files, tested).collect()} == want and len(want) > 150
    own = fd.where("scan_job_id = 7 AND file_path IS NOT NULL").selectExpr("scan_job_id", "file_path AS path").distinct()
    long = files.where("length(file_name) >= 5").selectExpr("scan_job_id", "file_name AS name")
    pairs = findings.pr_candidates(own, long).count()
    assert pairs < 0.02 * own.count() * long.count()
    all_ = table([(7, "")], "scan_job_id long, file_name string")
    assert findings.in_pr_files(fd, all_, 1).count() == sum(j == 7 for _, j, _ in rows)


def test_languages(table):
    df = table([("a/b.PY",), ("x.tar.hpp",), (".bashrc",), ("d.d/noext",), (None,)], "p string")
    assert [r[0] for r in df.select(languages.scanner_language(F.col("p"))).collect()] == ["python", "cpp", None, None, None]
    with pytest.raises(ValueError):
        languages.select_languages(df, ["cobol"])


# ---------------------------------------------------------- equal depth


def test_chunks_of_equal_depth(table):
    rng = random.Random(4)
    # A third of the rows is one key's, nine tenths of them within one of its ten thousand seconds.
    places = [rng.randrange(5000, 5001) * 1000 + rng.randrange(1000) if rng.random() < 0.9 else rng.randrange(10**7) for _ in range(3000)]
    rows = [("hot", p) for p in places] + [(None, rng.randrange(100)) for _ in range(700)] + [(f"k{i % 900}", i) for i in range(5000)]
    rows += [("hot", None), (None, None), ("tie", 5)] + [("tie", 5)] * 400
    df = table([(i, k, p) for i, (k, p) in enumerate(rows)], "id long, k string, p long").repartition(4)
    got = ordered.equal_depth(df, ["k"], F.col("p"), "c", 100).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append((r.p if r.p is not None else -1, r.c))
    for k, own in by_key.items():
        own.sort()
        assert all(a[1] <= b[1] for a, b in zip(own, own[1:]))
        assert all(a[1] == b[1] for a, b in zip(own, own[1:]) if a[0] == b[0])
        if k not in ("hot", None):
            assert {c for _, c in own} == {0}
    depth = lambda k: max(sum(c == d for _, d in by_key[k]) for c in {c for _, c in by_key[k]})
    assert depth("hot") <= 200 and len({c for _, c in by_key["hot"]}) >= 25 and depth(None) <= 250
    keyless = ordered.equal_depth(df, [], F.col("p"), "c", 100).groupBy("c").count().collect()
    assert sum(r["count"] for r in keyless) == len(rows) and len(keyless) > 40
    assert ordered.equal_depth(df.filter("false"), ["k"], F.col("p"), "c", 100).count() == 0


def test_gauge_in_busy_minutes(table):
    rng = random.Random(5)
    rows = [(i, T0 + timedelta(microseconds=rng.randrange(10**6)), rng.choice(["a", "a", "b"]), rng.choice([1, -1])) for i in range(900)]
    df = table(rows, "order_id long, ts timestamp, lane string, delta int")
    for keys in (None, ["lane"]):
        want, totals = {}, {}
        for i, ts, lane, delta in sorted(rows, key=lambda r: (r[1], r[0])):
            k = lane if keys else None
            totals[k] = want[i] = totals.get(k, 0) + delta
        got = metrics.active_gauge(df, keys=keys, rows=40)
        assert got.columns == [*df.columns, "active"] and {r.order_id: r.active for r in got.collect()} == want


# ----------------------------------------------------------------- cache


def brute_lookup(asked, written):
    out = {}
    for rid, key, ts in asked:
        best = max((w for w in written if w[0] == key and w[2] <= ts), key=lambda w: w[2], default=None)
        out[rid] = best[1] if best and ts < best[2] + timedelta(seconds=best[3]) else None
    return out


@pytest.mark.parametrize("rows", [7, 50, 10**7])
def test_lookup_hot_key(table, rows):
    rng = random.Random(2)
    times = rng.sample(range(20000), 400)
    asked = [(i, "hot" if i % 3 else f"k{i % 5}", T0 + timedelta(seconds=times[i])) for i in range(200)]
    written = [("hot" if i % 3 else f"k{i % 5}", f"p{i}", T0 + timedelta(seconds=times[200 + i]), rng.choice([10, 500, 5000])) for i in range(200)]
    reqs = table(asked, "request_id long, key string, ts timestamp")
    ents = table(written, "key string, payload string, cached_at timestamp, ttl_s long")
    got = cache.lookup(reqs, ents, rows).collect()
    assert {r.request_id: r.payload for r in got} == brute_lookup(asked, written)
    assert all(r.hit == (r.payload is not None) for r in got)


def test_put_and_clear(table):
    ddl = "key string, path string, payload string, cached_at timestamp, ttl_s long"
    old = table([("a", "f", "1", T0, 60), ("b", "g", "2", T0, 60)], ddl)
    new = table([("a", "f", "3", T0 + timedelta(seconds=1), 60)], ddl)
    now = cache.put(old, new)
    assert {r.key: r.payload for r in now.collect()} == {"a": "3", "b": "2"}
    assert cache.invalidate_files(now, table([("f",)], "path string")).count() == 1
    assert cache.invalidate_keys(now, table([("b",)], "key string")).count() == 1
    assert cache.clear(now).count() == 0
    asked = table([(1, "a"), (2, "b"), (3, "c")], "request_id long, key string")
    at = F.lit(T0 + timedelta(seconds=60))
    assert [r.hit for r in cache.lookup_current(asked, now, at).orderBy("request_id").collect()] == [True, False, False]


def test_hit_rate_without_requests(table):
    df = table([(0, 0), (1, 2)], "h long, m long")
    assert [r[0] for r in df.select(cache.hit_rate(F.col("h"), F.col("m"))).collect()] == [0.0, 33.33]


# -------------------------------------------------------------- throttle


@pytest.mark.parametrize("rate,per", [(2, 10.0), (3, 60.0), (1, 5.0)])
def test_token_bucket_against_plain_loop(table, rate, per):
    rng = random.Random(3)
    rows, now = [], 0.0
    for i in range(500):
        now += rng.choice([0.1, 0.5, 2.0, per, per * 3])
        rows.append((i, "hot" if i % 3 else f"k{i % 4}", T0 + timedelta(seconds=round(now, 3))))
    got = {r.request_id: r.admitted for r in throttle.token_bucket(table(rows, "request_id long, key string, ts timestamp"), rate, per).collect()}
    state = {}
    for i, key, ts in rows:
        at = ts.timestamp()
        level, last = state.get(key, (float(rate), at))
        level = min(float(rate), level + (at - last) * rate / per)
        ok = level >= 1.0
        state[key] = (level - 1.0 if ok else level, at)
        assert got[i] == ok
    assert len(got) == len(rows)


def test_runs_split_the_hot_key(table):
    rows = [(i, "hot", T0 + timedelta(seconds=i * 100)) for i in range(50)]
    df = table(rows, "request_id long, key string, ts timestamp")
    runs = lambda rate, per: throttle.runs_of(df, rate, per).select("run").distinct().count()
    assert runs(1, 100) == 50
    # No full pause of 300 seconds, but three admissions in it keep up with the requests.
    assert runs(3, 300) == 50
    assert runs(1, 101) == 1


def test_runs_start_where_nothing_is_owed(table):
    rng = random.Random(5)
    rows, now = [], 0
    for i in range(400):
        now += rng.choice([0, 1, 3, 10, 90])
        rows.append((i, "hot", T0 + timedelta(seconds=now)))
    got = {r.request_id: r.run for r in throttle.runs_of(table(rows, "request_id long, key string, ts timestamp"), 2, 30).collect()}
    debt, cuts = 0.0, set()
    for i, _, ts in rows:
        at = ts.timestamp()
        if at >= debt:
            cuts.add(i)
        debt = max(debt, at) + 15 * (max(debt, at) - at <= 15)
    starts = {i for i, _, _ in rows if i == 0 or got[i] != got[i - 1]}
    assert starts <= cuts and len(starts) > 20


@pytest.mark.parametrize("rate,per,gap", [(3, 60.0, 2.0), (2, 30.0, 16.0), (0.5, 5.0, 7.0)])
def test_unbroken_overload_in_many_tasks(table, rate, per, gap):
    """Long runs are admitted in chunks; the answers are those of the loop."""
    rng = random.Random(9)
    rows, now = [], 0.0
    for i in range(1500):
        now += rng.choice([0, rng.random() * gap])
        rows.append((i, "hot", T0 + timedelta(microseconds=round(now * 1e6))))
    rows += [(5000 + i, None if i % 2 else "other", T0 + timedelta(seconds=3 * i)) for i in range(60)]
    df = table(rows, "request_id long, key string, ts timestamp").repartition(3)
    want, debts = {}, {}
    for i, k, ts in rows:
        if k is not None:
            debts[k], want[i] = throttle.debt_after(debts.get(k), round(ts.timestamp() * 1e6), rate, round(per * 1e6))
    got = throttle.token_bucket(df.where("key IS NOT NULL"), rate, per, long_run=400, rows=64).collect()
    assert {r.request_id: r.admitted for r in got} == want and len(got) == len(want)
    if rate < 1:
        assert not any(want.values())
        return
    long = throttle.runs_of(df.where("key = 'hot'"), rate, per)
    first = throttle.first_stretch(long.select("key", "run", "us", "request_id"), rate, per, 64)
    for r in first.collect():
        assert r.clear is not None and r.i >= r.clear or r.admitted == want[r.request_id]


# ---------------------------------------------------------------- review


def test_verdict_rules(table):
    import json

    ok = {"decision": "true_positive", "confidence": 1.0, "reasoning": "x" * 10, "cwe_ids": ["CWE-1"]}
    cases = [
        (ok, True), ({**ok, "decision": "yes"}, False), ({**ok, "confidence": 1.01}, False), ({**ok, "reasoning": "short"}, False),
        ({**ok, "reasoning": "x" * 501}, False), ({**ok, "severity": "HIGH"}, False), ({**ok, "severity": "high"}, True),
        ({**ok, "exploitability": "x" * 201}, False), ({**ok, "remediation": "x" * 300}, True), ({}, False),
    ]
    df = table([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, "no json"), (91, None)], "i long, content string")
    got = {r.i: r for r in review.parse_verdicts(df).collect()}
    assert [got[i].valid for i in range(len(cases))] == [v for _, v in cases]
    assert (got[90].decision, got[90].confidence, got[91].decision) == ("uncertain", 0.0, "uncertain")
    assert got[0].cwe_ids == ["CWE-1"]


def test_review_asks_each_prompt_once(spark, table, tmp_path):
    fd = table(
        [(i, "bandit", "B105", "HIGH", "Hardcoded password", "f.py", 3, "x = 1") for i in range(40)]
        + [(99, "bandit", "B101", "LOW", "Unchecked buffer", "g.py", 4, "y")],
        "id long, tool string, rule_id string, severity string, description string, file_path string, line_number int, code_snippet string",
    )
    empty = table([], "key string, path string, payload string, cached_at timestamp, ttl_s long")
    path = str(tmp_path / "responses")
    out = review.review(fd, empty, offline_completer, responses_path=path)
    assert out.count() == 41
    fresh = spark.read.parquet(path)
    assert fresh.count() == 2
    entries = review.cache_entries(fresh, F.lit(T0))
    assert entries.count() == 2
    again = review.review(fd, entries, lambda texts: [None] * len(texts), now=F.lit(T0 + timedelta(hours=1)))
    assert {r.decision for r in again.collect()} == {"true_positive", "false_positive"}
    late = review.review(fd, entries, lambda texts: [None] * len(texts), now=F.lit(T0 + timedelta(days=2)))
    assert {r.decision for r in late.collect()} == {"uncertain"}
    assert review.call_records(fresh, "openai", "gpt-4o", F.lit(T0)).where("cost_usd > 0").count() == 2


# ----------------------------------------------------------------- fixes


def test_templates(spark, table):
    templates = fixes.template_table(spark)
    fd = table(
        [(1, "B303", "a.py"), (2, "B608", "a.py"), (3, "react/no-danger", "a.tsx"), (4, "B303", "a.js"), (5, "none", "a.py"), (6, "G401", "x.go")],
        "id long, rule_id string, file_path string",
    )
    got = {r.id: r for r in fixes.match_templates(fd, templates).collect()}
    assert [got[i].vulnerability_type for i in range(1, 7)] == ["weak_crypto_md5", "sql_injection", "xss", None, None, "weak_crypto_go"]
    assert "bcrypt" in got[1].template
    assert "parameterized" in got[2].template_explanation
    by_language = {r.language: r.rule_ids for r in fixes.supported_rules(templates).collect()}
    assert by_language["go"] == ["G201", "G202", "G401", "G501"]
    assert fixes.templates_for_language(templates, "rust").count() == 1


def test_fix_checks(table):
    df = table([("a", " a "), ("a", "\n"), ("a", None), ("a", "b")], "o string, f string")
    assert [r[0] for r in df.select(fixes.is_real_fix(F.col("o"), F.col("f"))).collect()] == [False, False, False, True]
    rows = [("x = (1)", "python"), ("x = ((1)", "Python"), ("x = ']' # (", "python"), ("x = (]", "python"), (None, "python"), ("x", "perl"), ("x(", "go")]
    got = [r[0] for r in table(rows, "c string, l string").select(fixes.syntax_check(F.col("c"), F.col("l"))).collect()]
    assert [g.ok for g in got] == [True, False, True, False, True, True, True]
    assert [got[i].message for i in (1, 3, 5)] == ["Unmatched brackets: (", "Unmatched brackets: (]", "Validation skipped (unsupported language: perl)"]


def test_fixes_apply_in_order(spark, table, tmp_path):
    files = table([("f", "a b a"), ("g", "x")], "file_path string, content string")
    steps = table([("f", 2, "b", "c"), ("f", 1, "a", "b"), ("f", 3, " \n", "zzz")], "file_path string, ord int, original_code string, fixed_code string")
    applied = fixes.apply_fixes(files, steps)
    assert [tuple(r) for r in applied.select("file_path", "content", "backup").collect()] == [("f", "c c c", "a b a")]
    path = str(tmp_path / "fixed")
    assert fixes.write_fixed_files(applied, path) and not (tmp_path / "fixed").exists()
    fixes.write_fixed_files(applied, path, dry_run=False)
    assert spark.read.parquet(path).first().backup == "a b a"


def test_line_changes(table):
    a, b = "x\ny\ny\nz\n", "x\ny\nw\nz"
    df = table([(1, a, b)], "finding_id long, original_code string, fixed_code string")
    got = sorted((r.op, r.line_number, r.line) for r in fixes.line_changes(df).collect())
    assert got == [("+", 3, "w"), ("-", 3, "y"), ("-", 5, "")]


def test_edits_far_apart_are_hunks_of_their_own(table):
    old = [f"line {i}" for i in range(900)]
    new = ["first", *old[1:899], "last", "more"]
    df = table([(1, "\n".join(old), "\n".join(new))], "finding_id long, original_code string, fixed_code string")
    got = sorted((r.op, r.line_number, r.line) for r in fixes.line_changes(df).collect())
    assert got == [("+", 1, "first"), ("+", 900, "last"), ("+", 901, "more"), ("-", 1, "line 0"), ("-", 900, "line 899")]


def test_changes_are_minimal_on_unique_lines():
    rng = random.Random(1)
    for n in range(300):
        pool = [str(i) for i in range(14)]
        a, b = rng.sample(pool, rng.randrange(12)), rng.sample(pool, rng.randrange(12))
        if n % 3 == 0:  # repeated lines: a valid change list, if not always the shortest
            a, b = rng.choices(pool[:4], k=8), rng.choices(pool[:4], k=9)
        removed, added = fixes.changed_lines(a, b)
        kept = [x for i, x in enumerate(a) if i not in removed]
        assert kept == [x for i, x in enumerate(b) if i not in added]
        if n % 3:
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            assert len(kept) == best[-1][-1]


@pytest.mark.parametrize(
    "a,b,changes",
    [
        ("a\nb\nc", "c\nb\na", {("-", 1, "a"), ("-", 2, "b"), ("+", 2, "b"), ("+", 3, "a")}),
        ("a\na", "a\na\na", {("+", 3, "a")}),
        ("a\nb", "a\nb", set()),
        ("", "x", {("-", 1, ""), ("+", 1, "x")}),
        (None, "x", set()),
    ],
)
def test_line_changes_inside_the_row(table, a, b, changes):
    df = table([(1, a, b)], "finding_id long, original_code string, fixed_code string")
    out = fixes.line_changes(df)
    assert {(r.op, r.line_number, r.line) for r in out.collect()} == changes
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


PYTHON = '''import os

class A(Base):
    """Text
that stands left of its class.
    """

    async def f(
        self,
    ):
        if x:
            return {
                1: 2,
            }

    @decorated
    def g(self): return 1

def h():
    def inner():
        pass
    return inner
x = 1
'''
SCRIPT = '''export default class Box extends Base {
  constructor(a, b) {
    if (a) {
      run();
    }
  }

  static async load(x) {
    return x;
  }
}
const go = async (x) => {
  return x;
};
function one() { return 1; }
'''


def test_symbol_spans(table):
    df = table([(1, PYTHON, "Python"), (2, SCRIPT, "javascript"), (3, "fn a() {}", "rust"), (4, None, "python"), (5, "", "python")], "i long, code string, lang string")
    out = df.select("i", symbol_spans(F.col("code"), F.col("lang")).alias("s")).collect()
    got = {r.i: sorted((s.start_line, s.end_line, s.kind, s.name) for s in r.s) for r in out}
    assert got[1] == [(3, 17, "class", "A"), (8, 14, "function", "f"), (17, 17, "function", "g"), (19, 22, "function", "h"), (20, 21, "function", "inner")]
    assert got[2] == [
        (1, 11, "class", "Box"), (2, 6, "function", "constructor"), (8, 10, "function", "load"), (12, 14, "function", None), (15, 15, "function", "one"),
    ]
    assert got[3] == got[4] == got[5] == []


COMMENTED = """class K:
    async def h(self):
        return "# not a comment"
# a comment at the left
    def i(self):
        x = (1,
2)
        return x \\
+ 1
# another
\'\'\'text
def quoted(): pass
\'\'\'
def j(): pass
"""

UNINDENTED = """function a(x) {
if (x) {
return "}" // }
}
}
class B extends mixin({}) {
m({p, q} = {}) {
const f = async (t) => {
/* { */
}
}
}
function overload(a);
export const g = v => {
`${v} {
{`
}
function open() {
x()
"""


def test_spans_whatever_the_layout():
    from triagelake.functions.symbols import javascript_spans, python_spans

    assert python_spans(COMMENTED) == [("class", "K", 1, 9), ("function", "h", 2, 3), ("function", "i", 5, 9), ("function", "j", 14, 14)]
    assert javascript_spans(UNINDENTED) == [
        ("function", "a", 1, 5), ("class", "B", 6, 12), ("function", "m", 7, 11), ("function", None, 8, 10), ("function", "overload", 13, 13), ("function", None, 14, 17), ("function", "open", 18, 19),
    ]
    assert python_spans("") == javascript_spans("") == [] and javascript_spans("}}{(") == [] and python_spans(")))\ndef a(): (") == [("function", "a", 2, 2)]


def test_spans_cost_grows_with_the_lines():
    import time

    from triagelake.functions.symbols import javascript_spans, python_spans

    def seconds(read, text):
        start = time.perf_counter()
        found = read(text)
        return time.perf_counter() - start, len(found)

    for read, one in ((python_spans, "class A{}:\n    def m(self):\n        return 1\n"), (javascript_spans, "class A{} {{\nm(x) {{\nreturn x\n}}\n}}\n")):
        small, n = seconds(read, "".join(one.format(i) for i in range(4_000)))
        large, m = seconds(read, "".join(one.format(i) for i in range(64_000)))
        assert (n, m) == (8_000, 128_000) and large < 60 * max(small, 0.01)


def test_files_are_named_by_repository_and_path(table):
    files = table([("a", "f", "1\n2\n3"), ("b", "f", "x")], "repo string, file_path string, content string")
    by = ["repo", "file_path"]
    found = table([("a", "f", 0), ("a", "f", 999), ("b", "f", 1), ("c", "f", 1), ("a", "f", None)], "repo string, file_path string, line_number int")
    for block in (20, 64, 512):
        got = {(r.repo, r.line_number): (r.context_start_line, r.context_end_line, r.context_code) for r in context.line_context(found, files, 10, block, by).collect()}
        assert got == {("a", 0): (1, 3, "1\n2\n3"), ("a", 999): (989, 3, ""), ("b", 1): (1, 1, "x"), ("c", 1): (None, None, None), ("a", None): (None, None, None)}
    steps = table([("a", "f", 1, "2", "two")], "repo string, file_path string, ord int, original_code string, fixed_code string")
    assert [tuple(r)[:3] for r in fixes.apply_fixes(files, steps, by).collect()] == [("a", "f", "1\ntwo\n3")]
    new = table([("a", "f", "h"), ("b", "f", "i")], "repo string, path string, hash string")
    status = incremental.compare_manifests(new, new, ["repo", "path"]).collect()
    assert [r.status for r in status] == ["same", "same"]
    kept = cache.invalidate_files(new, table([("a", "f")], "repo string, path string"), ["repo", "path"])
    assert [r.repo for r in kept.collect()] == ["b"]


def test_five_calls_in_flight(table):
    """Answers come in order, five calls run at once, a call that fails costs its own row."""
    import threading
    import time

    lock, open_ = threading.Lock(), [0, 0]
    answer = '{"decision": "true_positive", "confidence": 0.5, "reasoning": "%s was read"}'

    def slow(texts):
        with lock:
            open_[0] += 1
            open_[1] = max(open_)
        time.sleep(0.02 + 0.03 * (len(texts[0]) % 3))
        with lock:
            open_[0] -= 1
        if "7" in texts[0]:
            raise RuntimeError(texts)
        return [answer % t for t in texts]

    frame = pd.DataFrame({"key": [str(i) for i in range(40)], "prompt": [f"prompt {i}" for i in range(40)], "content": [None] * 40})
    frame.loc[3, "content"] = "kept"
    (out,) = review._complete(slow, 1, "", 5)(iter([frame]))
    assert open_[1] == 5 and out["content"][3] == "kept"
    for i in range(40):
        if i != 3:
            assert out["content"][i] == (None if "7" in str(i) else answer % f"prompt {i}")

    def failing(texts):
        if "7" in texts[0]:
            raise ValueError(texts)
        return [answer % t for t in texts]

    asked = table([(str(i), f"prompt {i}") for i in range(20)], "key string, prompt string")
    got = {r.key: r.decision for r in review.parse_verdicts(review.complete_prompts(asked, failing).select("key", "content")).collect()}
    assert got == {str(i): "uncertain" if "7" in str(i) else "true_positive" for i in range(20)}


def test_repeated_batches_are_stored_once(spark, table, tmp_path):
    ddl = "timestamp timestamp, provider string, cost_usd double"
    rows = [(datetime(2024, m, 5), p, c) for m in (1, 2, 3) for p, c in (("openai", 0.5), (None, None), ("openai", 0.5))]
    path = str(tmp_path / "costs")
    costs.write_costs(table(rows, ddl), path)
    costs.write_costs(table(rows, ddl), path)
    assert spark.read.parquet(path).count() == 6
    costs.write_costs(table([(datetime(2024, 3, 5), "openai", 0.25), *rows[:2]], ddl), path)
    assert spark.read.parquet(path).count() == 7
    costs.write_costs(table([], ddl), path)
    assert spark.read.parquet(path).count() == 7


def test_merged_sketches_equal_direct_ones(table):
    rng = random.Random(2)
    rows = [(T0 + timedelta(seconds=rng.randrange(2 * 86400)), rng.choice(["a", "a", "b"]), rng.choice([None, rng.expovariate(1.0)])) for _ in range(6000)]
    df = table(rows, "ts timestamp, lane string, d double")
    exact = {(r.window_start, r.lane): (r.n, r.quantile) for r in metrics.exact_quantile(df, 0.9, ["lane"], "d").collect()}
    fine = metrics.quantile_sketches(df, ["lane"], "d", seconds=300)
    for sketches in (metrics.merge_sketches(fine, ["lane"], "day"), metrics.merge_sketches(metrics.merge_sketches(fine, ["lane"], "hour"), ["lane"], "day")):
        got = metrics.sketched_quantile(sketches, 0.9).collect()
        assert len(got) == len(exact) == 4
        for r in got:
            own = [d for ts, lane, d in rows if d is not None and lane == r.lane and ts.date() == r.window_start.date()]
            assert r.n == exact[r.window_start, r.lane][0] == len(own)
            assert abs(sum(d <= r.quantile for d in own) / len(own) - 0.9) < 0.01
            assert abs(sum(d <= exact[r.window_start, r.lane][1] for d in own) / len(own) - 0.9) < 2 / len(own)


def test_verdicts_are_one_strict_object(table):
    good = '{"decision": "true_positive", "confidence": %s, "reasoning": "long enough text"}'
    texts = [good % "0.9", good % '"0.9"', (good % "0.9") + " and more", (good % "0.9") + "] x", (good % "0.9").replace('"', "'"), "[%s]" % (good % "0.9"), good % '"x"', good % "0.9" + "," + good % "0.9", "", None, " " + good % "0.5" + "\n"]
    out = review.parse_verdicts(table(list(enumerate(texts)), "id long, content string"))
    assert [r.id for r in out.where("valid").orderBy("id").collect()] == [0, 1, 10]
    assert out.where("id = 1").first().confidence == 0.9


def test_stored_costs_are_read_by_month(spark, table, tmp_path):
    rows = table([(datetime(2024, m, 5), "openai") for m in range(1, 9)], "timestamp timestamp, provider string")
    path = str(tmp_path / "costs")
    costs.write_costs(rows, path)
    kept = costs.in_range(spark.read.parquet(path), datetime(2024, 3, 1), datetime(2024, 4, 30))
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_missing_path_meets_an_empty_name(table):
    found = table([(1, 1, None), (2, 1, "a.py"), (3, 2, None)], "id long, scan_job_id long, file_path string")
    names = table([(1, ""), (2, "b.py")], "scan_job_id long, file_name string")
    assert sorted(r.id for r in findings.in_pr_files(found, names).collect()) == [1, 2]
