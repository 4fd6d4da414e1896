"""Response and scan caches as tables: write, look up, count, invalidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators.ordered import DEPTH, carry_forward, equal_depth

# Time to live in seconds.
RESPONSE_TTL = 86400
SCAN_TTL = 3600


def lookup(requests: DataFrame, entries: DataFrame, rows: int = DEPTH) -> DataFrame:
    """Each request with the newest entry of its key written before it, if still alive.

    ``requests`` is ``(request_id, key, ts)``, ``entries`` ``(key, payload, cached_at, ttl_s)``.
    Adds ``payload`` (null on a miss), ``cached_at`` and ``hit``.

    An "as of" lookup without pairing requests and entries: both are laid on one time line
    per key and the latest entry is carried forward, in stretches of about ``rows`` rows, so a key
    that draws a third of all requests is worked on by many tasks, however busy a minute.
    """
    asked = requests.select(
        "key", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("kind"), "request_id",
        F.lit(None).cast("struct<payload:string,cached_at:timestamp,ttl_s:bigint>").alias("entry"),
    )
    written = entries.select(
        "key", F.col("cached_at").cast("timestamp").alias("ts"), F.lit(0).alias("kind"),
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
        F.struct(
            F.col("payload").cast("string").alias("payload"),
            F.col("cached_at").cast("timestamp").alias("cached_at"),
            F.col("ttl_s").cast("long").alias("ttl_s"),
        ).alias("entry"),
    )
    line = asked.unionByName(written)
    line = equal_depth(line, ["key"], F.unix_micros("ts"), "depth", rows)
    latest = carry_forward(line, ["key"], ["ts", "kind", "request_id"], F.col("depth"), "entry", "latest")
    alive = F.unix_micros("ts") < F.unix_micros("latest.cached_at") + F.col("latest.ttl_s") * 1000000
    return (
        latest.where("kind = 1")
        .withColumn("hit", F.coalesce(alive, F.lit(False)))
        .select(
            "request_id",
            "key",
            "ts",
            F.when(F.col("hit"), F.col("latest.payload")).alias("payload"),
            F.when(F.col("hit"), F.col("latest.cached_at")).alias("cached_at"),
            "hit",
        )
    )


def live_entries(entries: DataFrame, now) -> DataFrame:
    """Entries not past their time to live at ``now``."""
    return entries.where(
        F.unix_micros(now) < F.unix_micros(F.col("cached_at").cast("timestamp")) + F.col("ttl_s") * 1000000
    )


def lookup_current(requests: DataFrame, snapshot: DataFrame, now) -> DataFrame:
    """Requests beside the current entry of their key (one row per key), null on a miss."""
    live = live_entries(snapshot, now).select("key", "payload")
    return requests.join(live, "key", "left").withColumn("hit", F.col("payload").isNotNull())


def put(snapshot: DataFrame, new_entries: DataFrame) -> DataFrame:
    """Snapshot after writing: the last write of each key wins.

    ``max_by`` combines on the map side, so a key written very often sends one row per task.
    """
    every = snapshot.unionByName(new_entries)
    rest = [c for c in every.columns if c != "key"]
    return (
        every.groupBy("key")
        .agg(F.max_by(F.struct(*rest), F.struct("cached_at", "payload")).alias("e"))
        .select("key", "e.*")
    )


def hit_rate(hits, misses):
    """Hits in percent, two decimals, 0.0 without requests."""
    return F.coalesce(F.bround(F.try_divide(hits * 100.0, hits + misses), 2), F.lit(0.0))


def stats(looked_up: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Entry count, hits, misses and hit rate in one row."""
    asked = looked_up.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.lit(0).cast("long").alias("total_keys")
    )
    stored = snapshot.agg(
        F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"), F.count("*").alias("total_keys")
    )
    return (
        asked.unionByName(stored)
        .agg(*[F.sum(c).alias(c) for c in ("total_keys", "hits", "misses")])
        .withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))
    )


def invalidate_files(snapshot: DataFrame, paths: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Drop cached scans of the given files; with several repositories ``by`` holds their key too."""
    return snapshot.join(paths.select(*by), [*by], "left_anti")


def invalidate_keys(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    return snapshot.join(keys.select("key"), "key", "left_anti")


def clear(snapshot: DataFrame) -> DataFrame:
    """An empty snapshot of the same shape."""
    return snapshot.limit(0)
