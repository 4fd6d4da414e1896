"""URL rules behind a blocked Bloom filter.

Every rule is a host and a path, written as one string (``example.com/en/``). A URL can only
be under a rule that equals one of its candidates: a suffix of its host by whole labels, and
a prefix of its path as long as some rule's path. All candidates are tested against a
blocked Bloom filter of the rules; the few that pass meet the rules in an exact hash join, which
removes false positives.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import U64, mix

#: Bits of a block; all bits of a key are in one block, so a test touches one cache line.
BLOCK_BITS = 512
#: Bits set for a key.
HASHES = 6
#: Upper bound of the filter that is sent to every executor. From some 33 million rules on it fills up: more
#: candidates pass to the exact join, which costs time; results stay the same.
MAX_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lowered, and the path up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.view(U64))
    block = (h % U64(blocks)).astype(np.int64)
    bits = np.stack([mix(h + U64(k + 1)) % U64(BLOCK_BITS) for k in range(HASHES)], axis=1).astype(np.int64)
    return block, bits


def bloom(rules: DataFrame, bits_per_rule: int = 16) -> np.ndarray:
    """A filter over ``rules.key`` (hashes), in blocks of ``BLOCK_BITS``; grows with the rules up to ``MAX_BYTES``.

    Every task makes the blocks its rules fall into; blocks are united per number, so
    that what reaches the driver is the filter itself and never the rules.
    """
    count = rules.count()
    blocks = int(min(max(1, -(-count * bits_per_rule // BLOCK_BITS)), MAX_BYTES * 8 // BLOCK_BITS))

    def filled(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            block, bits = _places(keys, blocks)
            used, row = np.unique(block, return_inverse=True)
            field = np.zeros((len(used), BLOCK_BITS), bool)
            field[row[:, None], bits] = True
            words = np.packbits(field, axis=1, bitorder="little").view(np.int64)
            yield pa.record_batch([pa.array(used), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(8)]], names=["block", *[f"w{i}" for i in range(8)]])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    rows = rules.select("key").mapInArrow(filled, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    out = np.zeros((blocks, BLOCK_BITS // 64), np.int64)
    for r in rows.toLocalIterator():
        out[r[0]] = r[1:]
    return out


def maybe(keys: np.ndarray, field: np.ndarray) -> np.ndarray:
    block, bits = _places(keys, len(field))
    words = field[block[:, None], bits >> 6]
    return ((words >> (bits & 63)) & 1).all(axis=1)


def _possible(batches, shared):
    field = shared.value
    for b in batches:
        keep = maybe(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), field) if b.num_rows else np.zeros(0, bool)
        yield b.filter(pa.array(keep))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds ``host, path, rule, verdict`` to rows with a ``url``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains of it where
    the url's path starts with the rule's path; the longest rule wins, by characters of host and path, then of
    host, then allow before block. Without a rule the verdict is ``default``. Null urls and urls without
    ``://`` have an empty host and path. Every row is kept, repeated rows included. Columns of ``pages`` called as
    the new ones are replaced. Without rules every row gets the default.
    """
    spark = pages.sparkSession
    lists = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "verdict").distinct()
    # One row for each rule string: the same host and path listed twice, or cut elsewhere.
    lists = lists.groupBy("rule", "host_length").agg(F.min("verdict").alias("verdict"), F.first("path_length").alias("path_length")).withColumn("key", F.xxhash64("rule"))
    # No more numbers than the longest path of a rule has characters.
    lengths = sorted(r[0] for r in lists.select("path_length").distinct().toLocalIterator())
    named = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    named = named.withColumn("host", host).withColumn("path", path)
    if not lengths:
        return named.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    shared = spark.sparkContext.broadcast(bloom(lists))

    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    starts = F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))
    keyed = named.filter("host <> ''").select("host", "path").distinct()
    keyed = keyed.select("host", "path", F.explode(suffixes).alias("suffix")).select("host", "path", "suffix", F.explode(starts).alias("start"))
    keyed = keyed.select("host", "path", F.length("suffix").alias("host_length"), F.concat("suffix", "start").alias("rule")).withColumn("key", F.xxhash64("rule"))
    likely = keyed.mapInArrow(partial(_possible, shared=shared), "host string, path string, host_length int, rule string, key long")
    exact = likely.drop("key").join(lists.drop("key", "path_length"), ["rule", "host_length"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "host_length", "rule", "verdict")).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict")
    joined = named.join(best, ["host", "path"], "left")
    return joined.select(*named.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
