"""Structured Streaming forms of the event-driven operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagelake.operators.throttle import debt_after
from triagelake.session import work_dir


def read_table_stream(
    spark: SparkSession, folder: str, file_name: str, schema: T.StructType, max_bytes: int = 1 << 30
) -> DataFrame:
    """A Parquet table of a folder as a stream, at most ``max_bytes`` of input per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    return reader.option("maxBytesPerTrigger", max_bytes).parquet(folder)


def read_json_stream(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """New JSON files of a folder, each read once."""
    return spark.readStream.schema(ddl).json(folder)


def read_report_stream(spark: SparkSession, folder: str, tool: str) -> DataFrame:
    """New report files of one tool, each picked up once, as rows for the report readers."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(
        F.col("_metadata.file_path").alias("report_id"),
        F.lit(tool).alias("tool"),
        F.col("value").alias("content"),
        F.lit(None).cast("string").alias("file_path"),
    )


def tumbling_totals(
    samples: DataFrame, labels: list[str], amount: Column, ts: str = "ts", size: str = "5 minutes",
    slide: str | None = None, late: str = "10 minutes",
) -> DataFrame:
    """Counts and sums per window and label set, with a watermark for late rows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    marked = samples.withWatermark(ts, late) if samples.isStreaming else samples
    return marked.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n"), F.sum(amount).alias("total")).select(
        F.col("w.start").alias("window_start"), *labels, "n", "total"
    )


def monthly_spend(entries: DataFrame, limit: float, ts: str = "timestamp") -> DataFrame:
    """Running cost per month with the budget flag; costs come as integer micro-dollars."""
    month = F.date_format(ts, "yyyy-MM")
    return entries.groupBy(month.alias("month")).agg(F.sum("cost_micros").alias("cost_micros")).withColumn(
        "over_budget", F.col("cost_micros") > int(limit * 1_000_000)
    )


def live_gauge(marks: DataFrame, labels: list[str]) -> DataFrame:
    """Current number of active scans per label set from +1 / −1 marks."""
    return marks.groupBy(*labels).agg(F.sum("delta").alias("active"))


_ANSWER = [T.StructField("request_id", T.LongType()), T.StructField("key", T.StringType())]
_LATE = T.StructField("late", T.BooleanType())
_ADMITTED = T.StructType([*_ANSWER, T.StructField("admitted", T.BooleanType()), _LATE])
_BUCKET_STATE = T.StructType([T.StructField("ahead", T.DoubleType()), T.StructField("last", T.LongType())])
_SEEN = T.StructType([*_ANSWER, T.StructField("hit", T.BooleanType()), _LATE])
_SEEN_STATE = T.StructType([T.StructField("written", T.LongType()), T.StructField("last", T.LongType())])


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch in time order; the trigger size bounds them."""
    return pd.concat(list(frames)).sort_values(["us", "request_id"])


def _answered(requests: DataFrame, name: str, answer: Callable, out: T.StructType, kept: T.StructType, keep_ms: int) -> DataFrame:
    """Answer every request of a key from one small state that expires ``keep_ms`` of processing time after it was last written.

    No watermark is set, so no request is dropped: one that comes after later ones were answered is
    answered from the state as it is, and marked late. ``answer`` takes a batch's times in order and the state
    before, and gives the answers and the state after; a state's last field is the latest time answered.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, before = _in_order(frames), state.get if state.exists else None
        answers, after = answer(rows["us"].tolist(), before)
        state.update(after)
        state.setTimeoutDuration(keep_ms)
        # Within a batch times are in order, so only those before an earlier batch's are late.
        late = rows["us"] < before[-1] if before else False
        yield pd.DataFrame({"request_id": rows["request_id"], "key": key[0], name: answers, "late": late})

    rows = requests.select("request_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("key").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def token_bucket_stream(requests: DataFrame, rate: float, per: float, keep_s: float = 0) -> DataFrame:
    """Token-bucket admission on a stream of ``(request_id, key, ts)``: ``request_id, key, admitted, late``.

    Every request is answered once, in the order in which batches bring them and by time within a
    batch. One that is older than an answered request of its key is ``late`` and counts as of that request's time. A bucket
    is full again ``per`` seconds after its last request, so its state expires when none has come for that long, or
    for ``keep_s`` seconds if that is longer; a key without state has a full bucket.
    """
    per_us = round(per * 1e6)

    def answer(times: list[int], before: tuple | None) -> tuple[list[bool], tuple]:
        ahead, last = before or (0, 0)
        debt, flags = last * rate + type(rate)(ahead), []
        for us in times:
            last = max(last, us)
            debt, admitted = debt_after(debt, last, rate, per_us)
            flags.append(admitted)
        return flags, (float(debt - last * rate), last)

    return _answered(requests, "admitted", answer, _ADMITTED, _BUCKET_STATE, round(max(per, keep_s) * 1000))


def ttl_cache_stream(requests: DataFrame, ttl_s: int, keep_s: int = 0) -> DataFrame:
    """First request of a key is a miss and writes; requests before the entry's end are hits: ``request_id, key, hit, late``.

    Late requests are answered by the entry there is, which may have been written after them. The
    state of a key expires when none has come for ``ttl_s`` seconds, or ``keep_s`` if that is longer.
    """
    ttl = ttl_s * 1_000_000

    def answer(times: list[int], before: tuple | None) -> tuple[list[bool], tuple]:
        written, last = before or (None, 0)
        hits = []
        for us in times:
            hit = written is not None and us < written + ttl
            written = written if hit else us
            hits.append(hit)
        return hits, (written, max([last, *times]))

    return _answered(requests, "hit", answer, _SEEN, _SEEN_STATE, max(ttl_s, keep_s) * 1000)


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(
    stream: DataFrame, purpose: str, mode: str = "append", keys: list[str] | None = None, idle_batches: bool = True
) -> DataFrame:
    """Run a stream over all input present and return what it wrote.

    Rows go to a table in the session's shared work folder with the stream's checkpoint
    beside it, never through the driver. In complete and update mode each batch is kept
    under its number and the newest row per key is returned. State that expires by processing time asks for
    batches without input for ever; ``idle_batches`` false ends such a stream with its input.
    """
    spark = stream.sparkSession
    base = work_dir(spark, purpose)
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(_keep_batch(out)).outputMode(mode)
    before = spark.conf.get(_IDLE, "true")
    spark.conf.set(_IDLE, before if idle_batches else "false")
    try:  # a stream keeps the settings it was started with
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_IDLE, before)
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    kept = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(kept).option("recursiveFileLookup", True).parquet(out)
    if mode == "complete":
        newest = rows.agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, "batch_id", "left_semi").drop("batch_id")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def _keep_batch(out: str) -> Callable[[DataFrame, int], None]:
    def keep(batch: DataFrame, batch_id: int) -> None:
        # A retried batch replaces its own folder.
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{out}/batch_{batch_id}"
        )

    return keep
