"""Token-bucket admission and expiring first-seen checks, per key and in time order."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.operators.ordered import DEPTH, equal_depth, running_min_before, running_number
from triagelake.session import stored

#: Requests of a run that one task streams.
LONG_RUN = 1 << 18


def debt_after(debt_until: float | None, us: int, rate: float, per_us: int) -> tuple[float, bool]:
    """Time up to which a key is in debt after a request at ``us``, and whether it is admitted.

    Times are counted in microseconds times ``rate``, so that one admission costs ``per_us``
    and whole rates give whole numbers. A key may run ahead by ``rate - 1`` admissions.
    """
    now = us * rate
    until = now if debt_until is None else max(debt_until, now)
    admitted = until - now <= (rate - 1) * per_us
    return until + per_us * admitted, admitted


def runs_of(requests: DataFrame, rate: float, per: float) -> DataFrame:
    """Number the runs of a key (``run``): at the start of each, the bucket is full whatever came before.

    If every request were admitted, a key would be in debt until the largest, over the earlier
    requests, of their time plus the cost of all from there on. Where that has passed,
    so has the real debt; and after a pause of ``per`` seconds nothing is owed whatever came before. Time is cut into slices of one admission; a slice is summed up by its
    first time, its number of requests and its own debt, and the window runs over that
    summary, not the rows. Costs are rounded up, so a cut is never too early.
    """
    cost = ceil(round(per * 1_000_000) / rate)
    timed = requests.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("slice", F.floor(F.col("us") / cost))
    # Requests of a slice from this one on; ties may stand in any order here.
    later = F.row_number().over(Window.partitionBy("key", "slice").orderBy(F.col("us").desc()))
    summary = timed.select("key", "slice", "us", (F.col("us") + later * F.lit(cost).cast("long")).alias("debt"))
    summary = summary.groupBy("key", "slice").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"), F.max("debt").alias("debt"))
    order = Window.partitionBy("key").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Debts are compared as of the first slice: later costs are taken off, and put back for the slice that asks.
    summary = summary.withColumn("spent", F.sum("n").over(order) * F.lit(cost).cast("long"))
    debt = F.max(F.col("debt") - F.col("spent")).over(before) + F.col("spent") - F.col("n") * F.lit(cost).cast("long")
    paused = F.col("first") - F.lag("last").over(order) >= ceil(per * 1_000_000)
    summary = summary.withColumn("starts", F.when(debt.isNull() | (debt <= F.col("first")) | paused, 1).otherwise(0))
    summary = summary.select("key", "slice", F.sum("starts").over(order).alias("run"))
    return timed.join(summary, ["key", "slice"]).drop("slice")


def _admit_sorted(rate: float, per: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per_us = round(per * 1e6)
        current, debt = None, None
        for frame in frames:
            flags = []
            for key, number, us in zip(frame["key"], frame["run"], frame["us"]):
                if (key, number) != current:
                    current, debt = (key, number), None
                debt, admitted = debt_after(debt, us, rate, per_us)
                flags.append(admitted)
            yield pd.DataFrame({"request_id": frame["request_id"], "key": frame["key"], "admitted": flags})

    return run


def first_stretch(requests: DataFrame, rate: float, per: float, rows: int = DEPTH) -> DataFrame:
    """Runs of :func:`runs_of` with ``admitted``, right up to ``clear``, the number of the first request that owes nothing (null: none).

    Until then the debt of a run falls due at known times: the k-th admission needs the time at which k - rate + 1
    admissions after the first request have been paid. So of the first i requests ``min(admitted before + 1, paid(i))`` are
    admitted, which is ``i`` plus the least ``paid(j) - j`` of the requests up to i where that is below zero: a
    running minimum, taken in chunks of about ``rows`` rows.
    """
    share = Fraction(rate).limit_denominator(1_000_000)
    cost, size = F.lit(round(per * 1_000_000) * share.denominator).cast("long"), F.lit(share.numerator).cast("long")
    keys, order = ["key", "run"], ["us", "request_id"]
    cut = equal_depth(requests, keys, F.col("us"), "depth", rows)
    begun = requests.groupBy(F.struct(*keys).alias("of")).agg(F.min("us").alias("begun"))
    cut = cut.withColumn("of", F.struct(*keys)).join(begun, "of").drop("of")
    numbered = running_number(cut, keys, order, F.col("depth"), "i")
    since = (F.col("us") - F.col("begun")) * size
    over = F.lit(round(per * 1_000_000) * (share.numerator - share.denominator)).cast("long")
    paid = F.expr("paid_for div cost") + 1
    timed = numbered.withColumn("since", since).withColumn("paid_for", F.col("since") + over).withColumn("cost", cost).withColumn("paid", paid)
    least = running_min_before(timed, keys, order, F.col("depth"), F.col("paid") - F.col("i"), "least")
    taken = F.col("i") - 1 + F.least(F.lit(0).cast("long"), "least")
    judged = least.withColumn("admitted", taken < F.col("paid")).withColumn("owes", taken * F.col("cost") > F.col("since"))
    clear = judged.where("i > 1 AND NOT owes").groupBy(F.struct(*keys).alias("of")).agg(F.min("i").alias("clear"))
    judged = judged.withColumn("of", F.struct(*keys)).join(clear, "of", "left")
    return judged.select("key", "run", "us", "request_id", "i", "admitted", "clear")


def token_bucket(requests: DataFrame, rate: float, per: float, long_run: int = LONG_RUN, rows: int = DEPTH) -> DataFrame:
    """``(request_id, key, admitted)`` for requests ``(request_id, key, ts)``; ids must be unique per key.

    Each key is cut where its bucket is full whatever was admitted before, into independent runs.
    Runs of up to ``long_run`` requests are sorted and streamed through Python in Arrow batches with
    one number of state. A longer run, in which a key asks for more than its rate without a
    break, is admitted by :func:`first_stretch` in many tasks up to where its debt clears after all; the rest
    is a run again. While a round settles half of a long run the rest goes through another, so their number is the
    logarithm of the run's length; a rest whose debt clears sooner than that is streamed. Rounds are
    written to the work folder.
    """
    kind = requests.schema["request_id"].dataType
    out = T.StructType(
        [
            T.StructField("request_id", kind),
            T.StructField("key", T.StringType()),
            T.StructField("admitted", T.BooleanType()),
        ]
    )
    if rate < 1:  # a bucket that never holds a whole token
        return requests.select("request_id", F.col("key").cast("string").alias("key"), F.lit(False).alias("admitted"))
    cut = runs_of(requests, rate, per).select("key", "run", "us", "request_id")
    # No run is longer than its key.
    busy = requests.groupBy("key").count().where(F.col("count") > long_run).first()
    short, long = _by_length(cut, long_run) if busy else (cut, None)
    done = _streamed(short, rate, per, out)
    while long is not None:
        judged = stored(first_stretch(long, rate, per, rows), "stretch")
        done = done.unionByName(judged.where("clear IS NULL OR i < clear").select("request_id", "key", "admitted"))
        rest = judged.where("i >= clear").select("key", "run", "us", "request_id", "clear")
        short, long = _by_length(rest, long_run)
        done = done.unionByName(_streamed(short, rate, per, out))
    return done


def _by_length(runs: DataFrame, long_run: int) -> tuple[DataFrame, DataFrame | None]:
    """Requests of runs to stream, and of long ones, if there are any, of which the round before settled half."""
    key = F.struct("key", "run")
    settled = F.max("clear") if "clear" in runs.columns else F.lit(None).cast("long")
    sizes = runs.groupBy(key.alias("of")).agg(F.count("*").alias("n"), settled.alias("settled"))
    long = sizes.where((F.col("n") > long_run) & F.coalesce(F.col("settled") > F.col("n"), F.lit(True))).select("of")
    if long.first() is None:
        return runs, None
    tagged = runs.withColumn("of", key)
    return tagged.join(long, "of", "left_anti").drop("of"), tagged.join(long, "of", "left_semi").drop("of")


def _streamed(runs: DataFrame, rate: float, per: float, out: T.StructType) -> DataFrame:
    ordered = runs.repartition("key", "run").sortWithinPartitions("key", "run", "us", "request_id")
    return ordered.mapInPandas(_admit_sorted(rate, per), out)
