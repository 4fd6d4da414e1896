"""Repeated runs of lines by a suffix array over line-ID sequences.

A document is the sequence of its lines that have a word. Prefix doubling ranks the suffixes of
all sequences by their first 1, 2, 4, ... lines: the rank of ``2h`` lines is the rank of the pair
(rank of ``h`` lines here, rank of ``h`` lines ``h`` lines further). A suffix whose first ``h`` lines occur nowhere
else is done, as no longer run from there can repeat, so every round works on fewer suffixes.

Suffixes that share their first ``n`` lines are neighbours in the array; such an interval of
longest common prefix of at least ``n`` is found by the two ranks of ``2^k <= n`` lines that cover
it. A run counts if it has ``min_words`` words. Every repeated run is the union of its shortest counting
parts, one from each of its lines forward and one from each backward, so the later copies of those parts
are exactly the later copies of the maximal runs, and doubling can end at the longest such part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.store import materialize
from triagelake.llm.texts import WORD, word_count

_NULL_ID = -(2**63)
_DOC = ["did", "doc"]


def _ids() -> list:
    """A document's name: its id (null first) and a hash of its text, so repeated rows are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("did"), F.xxhash64("text").alias("doc")]


def line_sequences(docs: DataFrame) -> DataFrame:
    """``did, doc, seq, line, line_no, stop``: lines that have a word, and the lines up to the next such one."""
    every = F.split(F.coalesce("text", F.lit("")), "\n")
    numbered = F.filter(F.transform(every, lambda x, i: F.struct(i.alias("line_no"), F.btrim(x).alias("line"))), lambda s: s["line"].rlike(WORD))
    rows = docs.select(*_ids(), F.size(every).alias("n"), numbered.alias("a"))
    # stop: where the next line with a word begins.
    starts = F.transform("a", lambda s: s["line_no"])
    stops = F.concat(F.slice(starts, 2, F.greatest(F.size("a"), F.lit(1))), F.array("n"))
    rows = rows.filter(F.size("a") > 0).select("did", "doc", F.posexplode(F.arrays_zip(F.col("a"), stops.alias("stop"))).alias("seq", "s"))
    return rows.select("did", "doc", "seq", F.col("s.a.line").alias("line"), F.col("s.a.line_no").alias("line_no"), F.col("s.stop").alias("stop"))


def _ranked(keys: DataFrame, on: list[str]) -> DataFrame:
    """A number for each key that several positions have, in the order of the keys."""
    several = keys.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return materialize(several.orderBy(*on).select(*on, F.monotonically_increasing_id().alias("name")), "ranks")


def first_ranks(positions: DataFrame) -> DataFrame:
    """``did, doc, seq, rank`` of the suffixes whose first line occurs elsewhere; ``positions`` has ``did, doc, seq, h1, h2``."""
    names = _ranked(positions, ["h1", "h2"])
    return materialize(positions.join(names, ["h1", "h2"]).select(*_DOC, "seq", F.col("name").alias("rank")), "suffixes")


def suffix_ranks(first: DataFrame, longest: int | None = None) -> list[DataFrame]:
    """Ranks of the first 1, 2, 4, ... lines of the suffixes that share them with another one.

    The last table is the suffix array of all repeated runs or, if ``longest`` is given, of
    their first lines up to the largest power of two within it.
    """
    levels, h = [first], 1
    while longest is None or 2 * h <= longest:
        ahead = F.first("rank").over(Window.partitionBy(*_DOC).orderBy("seq").rangeBetween(h, h))
        paired = materialize(levels[-1].withColumn("ahead", ahead).filter("ahead is not null"), "pairs")
        names = _ranked(paired, ["rank", "ahead"])
        if names.isEmpty():
            break
        joined = paired.join(names, ["rank", "ahead"])
        levels.append(materialize(joined.select(*_DOC, "seq", F.col("name").alias("rank")), "suffixes"))
        h *= 2
    return levels


def _windows(positions: DataFrame, first: DataFrame, min_words: int) -> DataFrame:
    """``did, doc, seq, length``: the shortest parts of ``min_words`` words from each line forward and backward."""
    rows = positions.join(first.select(*_DOC, "seq"), [*_DOC, "seq"]).select(*_DOC, "seq", "words")
    order = Window.partitionBy(*_DOC).orderBy("seq")
    rows = rows.withColumn("block", F.col("seq") - F.row_number().over(order))
    rows = rows.withColumn("upto", F.sum("words").over(Window.partitionBy(*_DOC, "block").orderBy("seq"))).withColumn("before", F.col("upto") - F.col("words"))
    forward = Window.partitionBy(*_DOC, "block").orderBy("before").rangeBetween(0, min_words - 1)
    backward = Window.partitionBy(*_DOC, "block").orderBy("upto").rangeBetween(-(min_words - 1), 0)
    rows = rows.select(
        *_DOC,
        "seq",
        "before",
        "upto",
        F.last(F.struct("seq", "upto")).over(forward).alias("f"),
        F.first(F.struct("seq", "before")).over(backward).alias("b"),
    )
    ahead = F.when(F.col("f.upto") - F.col("before") >= min_words, F.struct(F.col("seq").alias("seq"), (F.col("f.seq") - F.col("seq") + 1).alias("length")))
    back = F.when(F.col("upto") - F.col("b.before") >= min_words, F.struct(F.col("b.seq").alias("seq"), (F.col("seq") - F.col("b.seq") + 1).alias("length")))
    both = rows.select(*_DOC, F.explode(F.array_distinct(F.filter(F.array(ahead, back), lambda x: x.isNotNull()))).alias("w"))
    return both.select(*_DOC, "w.seq", "w.length").distinct()


def later_copies(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``did, doc, removed``: the numbers of the lines in later copies of repeated runs, blank lines after them included.

    Order is that of doc_id (null first), then line; the first copy of a run stays.
    """
    lines = line_sequences(docs)
    # Repeated rows are one document.
    repeats = not docs.select(*_ids()).groupBy(*_DOC).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    hashed = lines.select(*_DOC, "seq", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), word_count(F.col("line")).cast("int").alias("words"), "line_no", "stop")
    positions = materialize(hashed.distinct() if repeats else hashed, "lines")
    first = first_ranks(positions)
    parts = materialize(_windows(positions, first, min_words), "parts")
    longest = parts.agg(F.max("length")).first()[0]
    levels = suffix_ranks(first, longest or 1)
    ranks = None
    for k, level in enumerate(levels):
        tagged = level.withColumn("k", F.lit(k))
        ranks = tagged if ranks is None else ranks.union(tagged)
    # ranks are tagged by k = floor(log2 length); a part without a rank occurs once.
    power = F.floor(F.log2("length")).cast("int")
    sized = parts.withColumn("k", power).withColumn("tail", F.col("seq") + F.col("length") - F.pow(F.lit(2), power).cast("int"))
    head = sized.join(ranks, [*_DOC, "seq", "k"]).withColumnRenamed("rank", "ra")
    named = materialize(head.join(ranks.withColumnsRenamed({"seq": "tail", "rank": "rb"}), [*_DOC, "tail", "k"]).select(*_DOC, "seq", "length", "ra", "rb"), "named")
    spot = F.struct("did", "doc", "seq")
    interval = named.groupBy("length", "ra", "rb").agg(F.min(spot).alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = named.join(materialize(interval, "intervals"), ["length", "ra", "rb"]).filter(spot > F.col("low"))
    gone = later.select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("length") - 1)).alias("seq")).distinct()
    spans = gone.join(positions.select(*_DOC, "seq", "line_no", "stop"), [*_DOC, "seq"]).select(*_DOC, F.sequence("line_no", F.col("stop") - 1).alias("r"))
    return spans.groupBy(*_DOC).agg(F.sort_array(F.flatten(F.collect_list("r"))).alias("removed"))


def remove_later_copies(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """The rows of ``docs`` with new ``text``, and ``lines, removed``: the number of lines and those taken out (from 0).

    Later copies of runs of lines with ``min_words`` words or more are deleted; lines are compared
    without blanks around them. A text of which nothing is deleted stays byte for byte; null stays null, an empty
    table stays empty. Repeated rows (same id and text) are one document and come out alike. Columns
    called ``lines`` or ``removed`` are replaced.
    """
    copies = later_copies(docs, min_words)
    base = docs.drop("lines", "removed")
    did, doc = _ids()
    every = F.split("text", "\n")
    joined = base.withColumn("_did", did).withColumn("_doc", doc).join(copies.toDF("_did", "_doc", "removed"), ["_did", "_doc"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(every, i + 1)), "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in base.columns],
        F.when(F.col("text").isNotNull(), F.size(every)).alias("lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )
