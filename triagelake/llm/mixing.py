"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.store import materialize
from triagelake.llm.texts import word_count

#: A rank in (0, 1) is cut into this many cells per level, and looked at level by level.
FAN = 256
LEVELS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], max_copies: float) -> DataFrame:
    """``source, source_size, target``: the total size shared by weight, at most ``max_copies`` times a source.

    Sources take the weights in code point order, null last, repeating. What a capped
    source cannot take is shared by weight among the others: with sources ordered by
    cap over weight, those before the first that stays under its share are capped, and
    the rest split what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_copies))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    fits = F.col("cap") / F.col("w") >= F.col("level")
    per = per.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("w"))).over(every))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("cap"), F.col("w") * F.col("level")).alias("target"))


def size_class(size: Column) -> Column:
    """Number of binary digits of a size: documents of one class differ in size by less than a factor of two."""
    return F.length(F.bin(size)).cast("int")


def expected_copies(classes: DataFrame, targets: DataFrame, max_copies: float, damping: float) -> DataFrame:
    """Adds ``expected``, the copies a document is to get on average, to rows of ``source, class, words``.

    It falls with the class as ``2 ** (-damping * class)``, is at most ``max_copies``, and the expected
    words of a source add up to its target. Classes are filled from the shortest documents on: those before the
    first that stays under ``max_copies`` get just that, the rest share what is left. A source has at most 64 classes.
    """
    both = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    most = F.lit(float(max_copies))
    both = both.withColumn("x", F.pow(F.lit(2.0), -damping * F.col("class")))
    order = Window.partitionBy("source").orderBy("class")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    both = both.withColumn("level", F.try_divide(left, F.sum(F.col("words") * F.col("x")).over(rest)))
    fits = F.col("level") * F.col("x") <= most
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("class"))).over(Window.partitionBy("source"))
    shared = F.greatest(F.least(F.coalesce(level * F.col("x"), most), most), F.lit(0.0))
    whole = F.col("target") >= most * F.col("source_size")
    expected = F.when(F.col("source_size") <= 0, 0.0).when(whole, most).otherwise(shared)
    return both.withColumn("expected", expected).drop("x", "level")


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, brought to (0, 1) without changing the order; 1 where nothing is to be drawn."""
    odds = u / (1 - u) / (inclusion / (1 - inclusion))
    return F.when(inclusion > 0, odds / (1 + odds)).otherwise(F.lit(1.0))


def _cut(docs: DataFrame, room: DataFrame) -> DataFrame:
    """``source, cut, left``: documents of ``docs`` with ``cell < cut`` are the longest prefix by rank that fits the room.

    One histogram per level: of the cell in which the running size passes the room, the
    next level looks at the parts. The rows of a source in a window are at most ``FAN``.
    """
    state = room.select("source", F.lit(0).cast("long").alias("prefix"), "room")
    for level in range(LEVELS):
        unit = FAN ** (LEVELS - 1 - level)
        inside = docs.join(state.toDF("s", "prefix", "room"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter(F.floor(F.col("cell") / (unit * FAN)) == F.col("prefix"))
        hist = inside.groupBy("source", F.floor(F.col("cell") / unit).alias("c")).agg(F.sum("size").alias("size"), F.first("room").alias("room"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("c"))
        cuts = (
            hist.withColumn("run", run)
            .groupBy("source")
            .agg(
                F.min(F.when(F.col("run") > F.col("room"), F.col("c"))).alias("c"),
                F.coalesce(F.max(F.when(F.col("run") <= F.col("room"), F.col("run"))), F.lit(0)).alias("used"),
            )
        )
        cuts = cuts.toDF("s", "c", "used")
        state = state.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            # Without a cell that passes the room, everything below the next prefix fits.
            F.coalesce("c", (F.col("prefix") + 1) * FAN).alias("prefix"),
            (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"),
        )
        state = materialize(state.coalesce(1), "cut")
    return state.toDF("source", "cut", "left")


def draw(docs: DataFrame, targets: DataFrame, max_copies: float = 3, damping: float = 0.25, fills: int = 2) -> DataFrame:
    """Adds ``copies, expected`` and the source's ``source_size, target`` to rows of ``source, size, u``.

    The expected copies of a document (:func:`expected_copies`) fall with its length, so that a few long documents do not
    fill the mix; with ``damping`` 0 they are target over size for all. Their whole part is certain. The fraction
    left is the document's inclusion probability of one more, which differs from class to class:
    documents are ranked by their random odds over their inclusion odds, and the first
    ones that together fill what the certain copies leave of the target are taken. The gap before the first
    document that no longer fits is filled from later ones of at most a quarter of it,
    ``fills`` times. Rows with equal ``u`` and size are drawn together.
    """
    docs = docs.withColumn("class", size_class(F.col("size")))
    classes = docs.groupBy("source", "class").agg(F.sum("size").alias("words"))
    plan = expected_copies(classes, targets, max_copies, damping)
    plan = plan.withColumn("whole", F.floor("expected")).withColumn("inclusion", F.col("expected") - F.floor("expected"))
    plan = materialize(plan.coalesce(1), "targets")
    rooms = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("room"))
    plan = plan.drop("words").withColumnsRenamed({"source": "s", "class": "k"})
    cells = F.floor(F.least(pareto_rank(F.col("u"), F.col("inclusion")), F.lit(1 - 2.0**-40)) * FAN**LEVELS)
    own = F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))
    ranked = docs.join(plan, own).drop("s", "k").withColumn("cell", cells)
    taken = F.lit(0)
    room = rooms
    ranked = ranked.filter("true")
    drawn = ranked.filter("inclusion > 0")
    for step in range(fills + 1):
        cuts = _cut(drawn.select("source", "size", "cell"), room).toDF("s", f"cut{step}", f"left{step}")
        limit = F.lit(2**62) if step == 0 else F.col(f"left{step - 1}") / 4
        ranked = ranked.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        hit = (F.col("inclusion") > 0) & (F.col("size") <= limit) & (F.col("cell") < F.col(f"cut{step}"))
        taken = F.when(hit, F.lit(1)).otherwise(taken)
        room = cuts.select(F.col("s").alias("source"), F.col(f"left{step}").alias("room"))
        drawn = ranked.filter((F.col("inclusion") > 0) & (taken == 0) & (F.col("size") <= F.col(f"left{step}") / 4))
    return ranked.withColumn("copies", F.col("whole") + F.coalesce(taken, F.lit(0)))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_copies: float = 3, seed: int = 17, damping: float = 0.25
) -> DataFrame:
    """``doc_id, text_hash, size, source_size, target, expected, copies, taken``, a row per document.

    Size is the number of words of the whole text, 0 for null. The random number of a
    document is a hash of seed, id and text, so runs agree, and repeated rows are taken
    together. An empty table gives an empty result; a source without any word gets no
    copies; other columns are not read.
    """
    text_hash = F.xxhash64("text")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text_hash), 11) + 0.5) / float(2**53)
    sizes = materialize(docs.select("doc_id", "source", text_hash.alias("text_hash"), word_count(F.col("text")).alias("size"), u.alias("u")), "sizes")
    drawn = draw(sizes, source_targets(sizes, weights, max_copies), max_copies, damping)
    return drawn.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", "expected", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each with its number of ``copies`` (1 or more)."""
    plan = mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "copies").distinct()
    keyed = docs.drop("copies").withColumn("_key", F.xxhash64("text"))
    return keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash"))).drop("_id", "_hash", "_key")
