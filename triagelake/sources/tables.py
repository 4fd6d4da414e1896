"""Typed reading and writing of the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.schemas import schema_of

#: Folder columns that let range queries prune.
PARTITION_COLUMNS = {"scan_jobs": "started_at", "audit_log": "timestamp"}

RULE_LIST_DDL = (
    "array<struct<name:string,language:string,tool:string,rule_id:string,enabled:boolean,"
    "severity_override:string,custom_message:string,description:string>>"
)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the declared columns of a table: cast, in order, missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(table).fields
        ]
    )


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A Parquet table with its declared schema; nothing is inferred."""
    return spark.read.schema(schema_of(table)).parquet(path)


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Store a table, by day where it has a time to prune on."""
    rows = conform(df, table)
    stamp = PARTITION_COLUMNS.get(table)
    writer = rows.withColumn("day", F.to_date(stamp)).write.partitionBy("day") if stamp else rows.write
    writer.mode(mode).parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str = "id", low: int = 0, high: int = 1 << 31, splits: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A relational table read in ``splits`` key ranges, brought to its declared schema."""
    rows = spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=splits, properties=properties or {}
    )
    return conform(rows, table)


def parse_rule_lists(batches: DataFrame) -> DataFrame:
    """Rules of JSON lists ``(batch_id, content)``, ``ord`` keeping their place; enabled by default."""
    rows = batches.select(
        "batch_id", F.posexplode(F.from_json("content", RULE_LIST_DDL, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})).alias("ord", "r")
    )
    return rows.select("batch_id", F.col("ord").cast("long").alias("ord"), "r.*").withColumn(
        "enabled", F.coalesce("enabled", F.lit(True))
    )


def read_rule_list(spark: SparkSession, path: str) -> DataFrame:
    """Rule-import files, each one JSON list."""
    files = spark.read.format("text").option("wholetext", True).load(path)
    return parse_rule_lists(files.select(F.col("_metadata.file_path").alias("batch_id"), F.col("value").alias("content")))


def audit_events(rows: DataFrame, event_type: str, ts: str, details: list[str]) -> DataFrame:
    """Audit rows of one kind; ``details`` are kept as JSON."""
    return conform(
        rows.select(
            F.col(ts).alias("timestamp"),
            F.lit(event_type).alias("event_type"),
            *[c for c in ("repo_full_name", "pr_number") if c in rows.columns],
            F.to_json(F.struct(*details)).alias("details"),
        ),
        "audit_log",
    )
