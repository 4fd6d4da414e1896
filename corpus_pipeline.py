"""A corpus through five of the operators, each stage written as Parquet and read by the next.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing to target weights.
Every stage works on all documents its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import decontaminate, jaccard, lines, mixing, toxicity
from triagelake.llm.store import materialize
from triagelake.llm.texts import WORD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels of these documents, does not reject."""
    grammar = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, grammar)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which no word is left."""
    out = lines.remove_later_copies(docs)
    out = out.filter((F.size("removed") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a shingle similarity of 0.8, the one with the smallest id stays."""
    return jaccard.keep_one(docs, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix at weights 5, 2, 1, with their number of copies."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Learning from labels and the joins of the stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
