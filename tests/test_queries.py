"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

# Queries of a subpackage that can be taken out are tested beside it.
QUERIES = {k: f for k, f in entry.queries().items() if k in entry.registry.queries()}
ORACLES = {k: s for k, s in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical
    assert "BroadcastNestedLoopJoin" not in physical
    assert "Join Cross" not in plan
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
