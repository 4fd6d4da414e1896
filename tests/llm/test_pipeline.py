"""The pipeline's stages and the registered queries of the operators."""

import duckdb
import pytest
from messy import docs, messy_rows, no_docs  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import TABLES, rows_of
from triagelake.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_stages(spark, docs, tmp_path, table):
    """Every stage keeps the columns, and takes out what it is there for."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    own = docs.select(*columns)
    insult = table([(500, "you stupid idiot " + "w " * 9, "en", "a", 30), (501, "Which planet of the solar system has the largest mass of all? Jupiter is the heaviest by far.", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    own.union(insult).write.parquet(f"{folder}/documents.parquet")
    table([(1, "Which planet of the solar system has the largest mass of all? Jupiter is the heaviest by far.")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, ids = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        assert now.columns == columns + ["copies"] * (k == 4)
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    every = {r.doc_id for r in own.collect()} | {500, 501}
    assert every - ids[0] == {500}
    # Documents that are copies line by line have nothing left; what was empty before stays.
    assert ids[0] - ids[1] == {2} and {5, 6, 7} <= ids[1]
    assert 1 in ids[2] and not ids[2] & {3, 9} and ids[2] - ids[3] == {501}
    assert ids[4] <= ids[3]


def test_stages_on_an_empty_table(spark, no_docs):
    now = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
