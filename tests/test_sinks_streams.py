"""Sinks read back, and streams fed in several files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from triagelake.operators.throttle import debt_after
from triagelake.schemas import TABLE_DDL, schema_of
from triagelake.session import work_dir
from triagelake.sinks import documents as doc
from triagelake.sinks import exports
from triagelake.sources import reports, tables
from triagelake.streaming import streams

T0 = datetime(2024, 1, 1)
FINDING = "id long, scan_job_id long, tool string, rule_id string, severity string, description string, file_path string, line_number int"


@pytest.fixture()
def found(table):
    rows = [(i, 1 if i < 23 else 2, "bandit", f"B{i}", "HIGH", 'say "hi" ✓', "a.py", i) for i in range(30)]
    return table([*rows, (99, 3, None, None, None, None, None, None)], FINDING)


def _documents(path, by):
    """Documents as written: the files of a folder, one after another by name."""
    return {
        d.name.removeprefix(f"{by}="): "".join(f.read_text() for f in sorted(d.glob("part-*")))
        for d in path.iterdir()
        if d.is_dir()
    }


def test_one_document_per_job(table, found, tmp_path):
    chunk = F.floor(F.col("id") / 5)
    jobs = table([(1,), (2,), (3,), (4,)], "scan_job_id long")
    doc.write_documents(doc.sarif_report(found, ["scan_job_id"], ["id"], chunk, jobs), str(tmp_path / "sarif"), ["scan_job_id"])
    logs = {k: json.loads(v) for k, v in _documents(tmp_path / "sarif", "scan_job_id").items()}
    assert sorted(logs) == ["1", "2", "3", "4"]
    assert [x["ruleId"] for x in logs["1"]["runs"][0]["results"]] == [f"B{i}" for i in range(23)]
    bare = logs["3"]["runs"][0]["results"][0]
    assert (bare["ruleId"], bare["level"], bare["message"]["text"]) == ("unknown", "warning", "Security issue found")
    place = bare["locations"][0]["physicalLocation"]
    assert (place["artifactLocation"]["uri"], place["region"]["startLine"]) == ("unknown", 1)
    assert logs["4"]["runs"][0]["results"] == [] and logs["4"]["$schema"].endswith("sarif-schema-2.1.0.json")
    doc.write_documents(doc.json_report(found, ["scan_job_id"], ["id"], chunk), str(tmp_path / "json"), ["scan_job_id"])
    reports = {k: json.loads(v) for k, v in _documents(tmp_path / "json", "scan_job_id").items()}
    assert sorted(reports) == ["1", "2", "3"]
    assert reports["1"]["total_findings"] == len(reports["1"]["findings"]) == 23
    assert reports["1"]["findings"][0]["description"] == 'say "hi" ✓' and reports["3"]["findings"][0]["rule_id"] is None
    whole = doc.json_report(found, [], ["id"], chunk).orderBy("number").collect()
    whole = json.loads("".join(r.text for r in whole))
    assert whole["total_findings"] == len(whole["findings"]) == 31
    nothing = doc.json_report(found.where("false"), [], ["id"], chunk).orderBy("number").collect()
    assert json.loads("".join(r.text for r in nothing)) == {"total_findings": 0, "findings": []}


def test_large_job_is_one_log(spark, tmp_path):
    """20 000 findings of one job among small ones, the job spread over ranges and chunks."""
    ids = spark.range(20_100).select("id", F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("scan_job_id"))
    found = ids.selectExpr("*", "concat('R', id) AS rule_id", "'LOW' AS severity", "'d' AS description", "'a.py' AS file_path", "1 AS line_number")
    rows = doc.sarif_report(found, ["scan_job_id"], ["id"], F.floor(F.col("id") / 1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        doc.write_documents(rows, str(tmp_path / "sarif"), ["scan_job_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "sarif" / "scan_job_id=7").glob("part-*"))) > 1
    logs = {k: json.loads(v) for k, v in _documents(tmp_path / "sarif", "scan_job_id").items()}
    assert len(logs) == 101
    assert [x["ruleId"] for x in logs["7"]["runs"][0]["results"]] == [f"R{i}" for i in range(20_000)]


def test_text_report_files(spark, table, found, tmp_path):
    jobs = table([(1,), (2,), (3,), (4,)], "scan_job_id long")
    report = doc.text_report(found, jobs, "scan_job_id", ["id"], F.floor(F.col("id") / 5))
    path = str(tmp_path / "text")
    doc.write_documents(report, path, ["scan_job_id"])
    text = spark.read.format("text").option("wholetext", True).load(f"{path}/scan_job_id=2").collect()
    body = "".join(r.value for r in text)
    assert body.startswith("\n🔍 Found 7 security issue(s):\n\n1. 🟠 [HIGH] B23\n   File: a.py:23\n   Tool: bandit\n")
    rows = {(r.scan_job_id, r.number): r.text for r in report.collect()}
    assert rows[(4, 0)] == "✅ No security issues found!"
    assert rows[(3, 1)] == "1. ⚠️ [UNKNOWN] unknown\n   File: unknown:?\n   Tool: unknown\n   Description: No description\n"


def test_payloads_are_json(found):
    url = F.lit("https://h/pr/1")
    slack = json.loads(doc.notifications(found, url, "slack").orderBy("id").first().payload)
    assert [b["type"] for b in slack["blocks"]] == ["header", "section", "section", "section"]
    assert slack["blocks"][1]["fields"][2]["text"] == "*File:*\na.py"
    assert "fields" not in slack["blocks"][0]
    discord = json.loads(doc.notifications(found, url, "discord").orderBy("id").first().payload)
    assert discord["embeds"][0]["color"] == 0xFF6600 and discord["embeds"][0]["url"] == "https://h/pr/1"
    assert doc.notifications(found, url, "slack", "CRITICAL").count() == 0


def test_exports(spark, table, tmp_path):
    scores = table([(T0, 0.5, None, None)], "timestamp timestamp, precision double, recall double, f1_score double")
    exports.write_metrics(scores, str(tmp_path / "csv"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert "timestamp,precision,recall,f1_score" in text and "2024-01-01T00:00:00,0.5,," in text
    exports.write_metrics(scores, str(tmp_path / "json"), "json")
    with pytest.raises(ValueError):
        exports.write_metrics(scores, str(tmp_path / "x"), "xml")
    snap = table([("daily", "go", 1), ("monthly", "go", 2)], "period string, language string, n int")
    exports.write_snapshots(snap, str(tmp_path / "snap"))
    exports.write_snapshots(snap, str(tmp_path / "snap"))
    # A stored set: the same batch twice leaves one copy.
    assert spark.read.parquet(str(tmp_path / "snap")).where("period = 'daily'").count() == 1
    event = tables.audit_events(table([(T0, "o/r", 1, "x")], "at timestamp, repo_full_name string, pr_number int, sha string"), "scan_started", "at", ["sha"])
    exports.append_audit(event, str(tmp_path / "audit"))
    tables.write_table(event, str(tmp_path / "audit2"), "audit_log")
    assert tables.read_table(spark, str(tmp_path / "audit2"), "audit_log").first().details == '{"sha":"x"}'
    rule = table([("n", None)], "name string, severity_override string")
    exports.write_rules(rule, str(tmp_path / "rules"))
    assert json.loads(spark.read.text(str(tmp_path / "rules")).first().value) == {"name": "n", "severity_override": None}
    reportdf = table([('{"a": 1}',)], "report string")
    exports.write_documents(reportdf, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first().value == '{"a": 1}'


def test_schemas_and_rule_files(spark, tmp_path):
    for name in TABLE_DDL:
        assert schema_of(name).fieldNames()
    (tmp_path / "rules.json").write_text('[{"name": "a", "tool": "gosec", "rule_id": "G1"}, {"name": "b", "enabled": false}]')
    rows = tables.read_rule_list(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.name, r.enabled) for r in rows] == [("a", True), ("b", False)]
    assert work_dir(spark, "x") != work_dir(spark, "x")


# --------------------------------------------------------------- streams


def _fill(spark, folder, parts, ddl):
    """One Parquet file per part, in the order a file source reads them."""
    import os
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        (name,) = [n for n in os.listdir(f"{folder}/tmp{i}") if n.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{i}/{name}", f"{folder}/in/part{i}.parquet")
        now = time.time() - 100 + i
        os.utime(f"{folder}/in/part{i}.parquet", (now, now))
    return f"{folder}/in"


def _stream(spark, folder, ddl):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(ddl)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


REQUEST = "request_id long, key string, ts timestamp"


def test_state_lasts_over_batches(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else "cold", T0 + timedelta(seconds=7 * i)) for i in range(60)]
    folder = _fill(spark, str(tmp_path), [rows[:20], rows[20:40], rows[40:]], REQUEST)
    out = streams.run_available(streams.token_bucket_stream(_stream(spark, folder, REQUEST), 2, 30.0), "t", idle_batches=False)
    got = {r.request_id: r.admitted for r in out.collect()}
    debts, want = {}, {}
    for i, k, ts in rows:
        debts[k], want[i] = debt_after(debts.get(k), round(ts.timestamp() * 1e6), 2, 30_000_000)
    assert got == want
    out = streams.run_available(streams.ttl_cache_stream(_stream(spark, folder, REQUEST), 60), "t", idle_batches=False)
    got = {r.request_id: r.hit for r in out.collect()}
    written, want = {}, {}
    for i, k, ts in rows:
        want[i] = k in written and ts < written[k] + timedelta(seconds=60)
        if not want[i]:
            written[k] = ts
    assert got == want


def test_late_requests_are_answered(spark, tmp_path):
    """A lagging source: every request is answered once, those behind answered ones are marked."""
    hour = timedelta(hours=1)
    parts = [
        [(1, "a", T0), (2, "b", T0 + 5 * hour)],
        [(3, "a", T0 + 9 * hour), (4, "a", T0 + 9 * hour + timedelta(seconds=1))],
        [(5, "a", T0 + hour), (6, "b", T0 + hour), (7, "c", T0)],
        [(8, "a", T0 + 9 * hour + timedelta(seconds=2)), (9, "b", T0 + 8 * hour)],
    ]
    folder = _fill(spark, str(tmp_path), parts, REQUEST)
    out = streams.run_available(streams.token_bucket_stream(_stream(spark, folder, REQUEST), 2, 30.0), "t", idle_batches=False)
    got = {r.request_id: (r.admitted, r.late) for r in out.collect()}
    late = {5, 6}
    # Requests 3 and 4 take both of a's tokens; 5 and 8 count within the same two seconds.
    assert got == {i: (i not in (5, 8), i in late) for i in range(1, 10)}
    out = streams.run_available(streams.ttl_cache_stream(_stream(spark, folder, REQUEST), 3600), "t", idle_batches=False)
    assert {r.request_id: (r.hit, r.late) for r in out.collect()} == {
        1: (False, False), 2: (False, False), 3: (False, False), 4: (True, False), 5: (True, True), 6: (True, True), 7: (False, False), 8: (True, False), 9: (False, False),
    }


def test_state_expires_by_processing_time(spark, tmp_path):
    """The state of a key nobody asks for is dropped; the key then starts anew."""
    import time

    folder = _fill(spark, str(tmp_path), [[(1, "a", T0), (2, "b", T0)]], REQUEST)
    stream = streams.ttl_cache_stream(_stream(spark, folder, REQUEST), 1)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    run()
    time.sleep(1.5)
    for row in ((3, "b", T0 + timedelta(days=1)), (4, "a", T0)):
        spark.createDataFrame([row], REQUEST).coalesce(1).write.mode("append").parquet(folder)
        run()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r.request_id: (r.hit, r.late) for r in spark.read.parquet(path).collect()}
    # Without its state, a's old request is a miss; with it, it would be a hit.
    assert got == {1: (False, False), 2: (False, False), 3: (False, False), 4: (False, False)}


SAMPLE = "ts timestamp, provider string, amount long"


def test_late_rows_are_dropped(spark, tmp_path):
    parts = [
        [(T0 + timedelta(minutes=1), "p", 1), (T0 + timedelta(hours=2), "p", 10)],
        [(T0 + timedelta(hours=2, minutes=1), "p", 20)],
        [(T0 + timedelta(minutes=2), "p", 1000), (T0 + timedelta(hours=4), "p", 5)],
    ]
    folder = _fill(spark, str(tmp_path), parts, SAMPLE)
    totals = streams.tumbling_totals(_stream(spark, folder, SAMPLE), ["provider"], F.col("amount"))
    rows = streams.run_available(totals, "t", "append").collect()
    assert {(r.window_start, r.total) for r in rows} == {(T0, 1), (T0 + timedelta(hours=2), 30)}


def test_running_results_per_key(spark, tmp_path):
    ddl = "timestamp timestamp, cost_micros long"
    parts = [[(T0, 400_000), (T0 + timedelta(days=40), 1)], [(T0 + timedelta(days=1), 700_000)]]
    folder = _fill(spark, str(tmp_path), parts, ddl)
    out = streams.run_available(streams.monthly_spend(_stream(spark, folder, ddl), 1.0), "t", "update", ["month"])
    assert {(r.month, r.cost_micros, r.over_budget) for r in out.collect()} == {("2024-01", 1_100_000, True), ("2024-02", 1, False)}


def test_reports_are_picked_up_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = reports.parse_bandit(streams.read_report_stream(spark, str(inbox), "bandit"))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.rule_id for r in spark.read.parquet(out).collect())

    (inbox / "a.json").write_text('{"results":[\n{"test_id": "B1"}]}')
    assert run() == ["B1"]
    (inbox / "b.json").write_text('{"results":[{"test_id": "B2"}]}')
    assert run() == ["B1", "B2"]
    assert run() == ["B1", "B2"]
