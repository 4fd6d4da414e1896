"""Tabular exports: metrics as CSV or JSON, rules as JSON, snapshots, audit rows, scan results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_to_set(rows: DataFrame, path: str, folder: str) -> None:
    """Append the rows that the table at ``path``, one folder per value of ``folder``, does not hold yet.

    Rows are compared whole, nulls equal. Of the stored rows only the folders the new ones touch are read. A
    job that is repeated, whether it had ended or not, leaves every row once; writers must not run at the same time.
    """
    new = rows.dropDuplicates()
    row = F.struct(*[F.col(c) for c in new.columns])
    try:
        held = rows.sparkSession.read.schema(new.schema).parquet(path).select(new.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        own = held.join(new.select(folder).distinct(), folder, "left_semi").select(row.alias("__row"))
        new = new.withColumn("__row", row).join(own, "__row", "left_anti").drop("__row")
    new.write.mode("append").partitionBy(folder).parquet(path)


def metrics_export(scores: DataFrame) -> DataFrame:
    """The exported columns of a metrics time series."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return scores.select(stamp.alias("timestamp"), "precision", "recall", "f1_score")


def write_metrics(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a metrics export; only csv and json are accepted."""
    if fmt not in ("csv", "json"):
        raise ValueError("format must be csv or json")
    writer = metrics_export(scores).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_rules(exported: DataFrame, path: str) -> None:
    """Rule export as JSON lines, null fields kept."""
    exported.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Add metric snapshots to the stored set, one folder per period."""
    add_to_set(snapshots, path, "period")


def append_audit(events: DataFrame, path: str) -> None:
    """Add audit events to the stored set, one folder per day."""
    add_to_set(events.withColumn("day", F.to_date("timestamp")), path, "day")


def write_scan_results(findings: DataFrame, path: str) -> None:
    """Scan results as JSON, one folder per language."""
    findings.write.mode("overwrite").partitionBy("language").json(path)


def write_documents(documents: DataFrame, path: str, column: str = "report") -> None:
    """One document per line of text output."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
