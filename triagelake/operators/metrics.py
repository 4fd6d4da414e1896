"""Precision, recall and F1 from user feedback, and operational metrics."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.ordered import DEPTH, equal_depth, running_sum

PERIOD_UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}

# Upper bounds of the default latency histogram buckets, in seconds.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def precision(tp: Column, fp: Column) -> Column:
    """TP / (TP + FP), null when there is nothing to divide by."""
    return F.try_divide(tp.cast("double"), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    """TP / (TP + FN), null when there is nothing to divide by."""
    return F.try_divide(tp.cast("double"), tp + fn)


def f1_score(p: Column, r: Column) -> Column:
    """Harmonic mean of precision and recall; null if either is null or both are 0."""
    return F.try_divide(2 * p * r, p + r)


def filter_window(
    df: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    language: str | None = None,
    tool: str | None = None,
    severity: str | None = None,
    ts: str = "created_at",
) -> DataFrame:
    """Optional filters of the metrics and feedback reports; dates are inclusive."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    for column, wanted in (("language", language), ("tool", tool), ("severity", severity)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


_KINDS = {
    "true_positives": "true_positive",
    "false_positives": "false_positive",
    "false_negatives": "false_negative",
}


def feedback_with_findings(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """Feedback rows beside the dimensions of the finding they judge."""
    dims = findings.select(
        F.col("id").alias("finding_id"), "scan_job_id", "language", "tool", "rule_id", "severity"
    )
    return feedback.join(dims, "finding_id")


def judged_findings(feedback: DataFrame, findings: DataFrame, bucket: Column | None = None) -> DataFrame:
    """One row per judged finding (and time bucket): its dimensions and its feedback counts.

    Feedback is counted per finding before the join, with partial aggregation on the map
    side, so a finding that drew a large share of all feedback joins as a single row.
    """
    keys = [F.col("finding_id")] + ([] if bucket is None else [bucket.alias("bucket")])
    counts = feedback.groupBy(*keys).agg(
        *[F.count_if(F.col("feedback_type") == v).alias(k) for k, v in _KINDS.items()],
        F.count("*").alias("total_feedback"),
    )
    return feedback_with_findings(counts, findings)


def with_scores(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """Add precision, recall and F1 to a frame of TP / FP / FN counts."""
    p = precision(F.col("true_positives"), F.col("false_positives"))
    r = recall(F.col("true_positives"), F.col("false_negatives"))
    out = counts.withColumns({"precision": p, "recall": r})
    out = out.withColumn("f1_score", f1_score(F.col("precision"), F.col("recall")))
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1_score")})
    return out


def _per_scan(judged: DataFrame, dims: list[str]) -> DataFrame:
    """Sums per group and scan job: the step that makes counting distinct scans cheap."""
    return judged.groupBy(*dims, "scan_job_id").agg(
        *[F.sum(c).alias(c) for c in _KINDS], F.count("*").alias("total_findings")
    )


def scores_by(judged: DataFrame, dims: list[str], digits: int | None = None) -> DataFrame:
    """Metrics per group of ``dims``; an empty list gives the overall summary.

    ``judged`` comes from :func:`judged_findings`; if it has a time bucket, ``dims`` must name it.
    """
    totals = _per_scan(judged, dims).groupBy(*dims).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*_KINDS, "total_findings"]],
        F.count("*").alias("total_scans"),
    )
    return with_scores(totals.withColumn("true_negatives", F.lit(0).cast("long")), digits)


def period_bucket(period: str, ts: str = "created_at") -> Column:
    """Start of the day, week (Monday) or month."""
    if period not in PERIOD_UNITS:
        raise ValueError(f"period must be one of {sorted(PERIOD_UNITS)}")
    return F.date_trunc(PERIOD_UNITS[period], F.col(ts))


def scores_by_period(
    feedback: DataFrame, findings: DataFrame, period: str = "daily", digits: int | None = None,
    days: int | None = None, now: datetime | None = None,
) -> DataFrame:
    """Time series of the metrics, of the last ``days`` (1 to 365) before ``now`` if given."""
    if days is not None:
        if not 1 <= days <= 365:
            raise ValueError("days must be between 1 and 365")
        end = now or datetime.now(UTC).replace(tzinfo=None)
        feedback = filter_window(feedback, start=end - timedelta(days=days), end=end)
    judged = judged_findings(feedback, findings, period_bucket(period))
    return scores_by(judged, ["bucket"], digits).withColumnRenamed("bucket", "timestamp").withColumn(
        "period", F.lit(period)
    )


def scores_by_dimension(judged: DataFrame, digits: int | None = None) -> DataFrame:
    """Language, tool and severity breakdowns in one pass over the feedback."""
    dims = ["language", "tool", "severity"]
    stacked = _per_scan(judged, dims).select(
        "*",
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dims])
        ).alias("slot"),
    )
    measures = [*_KINDS, "total_findings"]
    totals = (
        stacked.groupBy("slot.dimension", "slot.label", "scan_job_id")
        .agg(*[F.sum(c).alias(c) for c in measures])
        .groupBy("dimension", "label")
        .agg(*[F.sum(c).alias(c) for c in measures], F.count("*").alias("total_scans"))
    )
    return with_scores(totals, digits)


def metric_snapshots(feedback: DataFrame, findings: DataFrame, period: str) -> DataFrame:
    """Snapshot rows per period, language, tool and severity."""
    judged = judged_findings(feedback, findings, period_bucket(period))
    return (
        scores_by(judged, ["bucket", "language", "tool", "severity"])
        .withColumnRenamed("bucket", "timestamp")
        .withColumn("period", F.lit(period))
    )


def counter(df: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    """A labelled counter: rows, or the sum of ``amount``, per label set."""
    value = F.count("*") if amount is None else F.sum(amount)
    return df.groupBy(*labels).agg(value.alias("total"))


def rate_per_second(
    df: DataFrame, labels: list[str], amount: Column, ts: str = "ts", seconds: int = 300
) -> DataFrame:
    """Per-second rate of a counter in tumbling windows."""
    w = F.window(F.col(ts), f"{seconds} seconds")
    return (
        df.groupBy(w.alias("w"), *labels)
        .agg(F.sum(amount).alias("total"))
        .select(F.col("w.start").alias("window_start"), *labels, "total", (F.col("total") / seconds).alias("per_second"))
    )


def histogram_quantile(
    df: DataFrame,
    q: float,
    labels: list[str],
    value: str,
    ts: str = "ts",
    seconds: int = 300,
    buckets: list[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Quantile per window and label set from bucket counts.

    Values are counted per bucket (a fixed number of counters per group, so a hot group
    costs no more memory), and the quantile is interpolated linearly inside its bucket;
    beyond the last finite bound the answer is that bound.
    """
    w = F.window(F.col(ts), f"{seconds} seconds")
    counts = df.groupBy(w.alias("w"), *labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(buckets)],
        F.count(value).alias("n"),
    )
    rank = F.col("n") * F.lit(q)
    result = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low = F.lit(0.0) if i == 0 else F.lit(float(buckets[i - 1]))
        below = F.lit(0) if i == 0 else F.col(f"le_{i - 1}")
        inside = F.col(f"le_{i}") - below
        here = low + (F.lit(float(buckets[i])) - low) * F.try_divide(rank - below, inside)
        result = F.when(F.col(f"le_{i}") >= rank, here).otherwise(result)
    return counts.where("n > 0").select(F.col("w.start").alias("window_start"), *labels, "n", result.alias("quantile"))


def exact_quantile(df: DataFrame, q: float, labels: list[str], value: str, ts: str = "ts", unit: str = "day") -> DataFrame:
    """The exact interpolated quantile per ``unit`` of time and label set.

    Values are counted per distinct value on the map side; a group costs its distinct values.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("window_start"), *labels)
    return rows.agg(F.count("*").alias("n"), F.percentile(F.col(value).cast("double"), q).alias("quantile"))


def quantile_sketches(df: DataFrame, labels: list[str], value: str, ts: str = "ts", seconds: int = 300, k: int = 400) -> DataFrame:
    """One KLL ``sketch`` of the values per window and label set: a few kilobytes whatever the rows, to be stored and merged.

    With ``k`` 400 a quantile's rank is off by less than one per cent of the rows, however many sketches were merged.
    """
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    rows = df.where(F.col(value).isNotNull()).groupBy(w.alias("w"), *labels)
    sketched = rows.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    return sketched.select(F.col("w.start").alias("window_start"), *labels, "n", "sketch")


def merge_sketches(sketches: DataFrame, labels: list[str], unit: str, k: int = 400) -> DataFrame:
    """Sketches of windows merged to a larger ``unit`` of time, or to fewer labels; the rows are not read again."""
    merged = sketches.groupBy(F.date_trunc(unit, "window_start").alias("window_start"), *labels)
    return merged.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_quantile(sketches: DataFrame, q: float) -> DataFrame:
    """Sketches with the ``quantile`` they give in place of the ``sketch``."""
    return sketches.withColumn("quantile", F.kll_sketch_get_quantile_double("sketch", F.lit(q))).drop("sketch")


def active_gauge(
    starts_ends: DataFrame, ts: str = "ts", order_id: str = "order_id", keys: list[str] | None = None,
    rows: int = DEPTH,
) -> DataFrame:
    """Running number of active scans after each start (+1) or end (−1) row.

    With or without ``keys``, stretches of about ``rows`` rows are summed apart and only their sums are windowed.
    """
    cut = equal_depth(starts_ends, keys or [], F.unix_micros(F.col(ts).cast("timestamp")), "__depth", rows)
    return running_sum(cut, keys or [], [ts, order_id], F.col("__depth"), F.col("delta"), "active").drop("__depth")
