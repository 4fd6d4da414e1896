"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import forest
from triagelake.llm.store import materialize

_SCHEMA = "u long, v long"


def _local(batches):
    """Each batch of edges becomes a spanning forest, so chains and dense groups shrink before a shuffle."""
    for b in batches:
        if not b.num_rows:
            continue
        u, v = forest(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that some edge of ``u, v`` names.

    Each round hangs all neighbours of a node under their smallest one; the number of
    rounds grows with the logarithm of a component's size. Rounds are written as tables,
    so a lost executor never costs more than one round. Loops and repeated edges are allowed.
    """
    names = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = materialize(edges.filter("u <> v").select("u", "v").mapInArrow(_local, _SCHEMA).distinct(), "edges")
    seen = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if row.n == 0 or (row.n, row.s) == seen:
            break
        seen = (row.n, row.s)
        now = materialize(_small(_large(now)), "edges")
    return names.join(now.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
