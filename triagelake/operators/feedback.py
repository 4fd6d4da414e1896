"""User feedback: intake, statistics and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.schemas import FEEDBACK_TYPES


def check_intake(incoming: DataFrame, findings: DataFrame) -> DataFrame:
    """Every incoming row with ``reason``: null if accepted, else why it is rejected."""
    known = findings.select(F.col("id").alias("finding_id"), F.lit(True).alias("__known"))
    bad_type = ~F.coalesce(F.col("feedback_type").isin(FEEDBACK_TYPES), F.lit(False))
    reason = F.when(bad_type, F.lit("invalid feedback_type")).when(
        F.col("__known").isNull(), F.lit("finding not found")
    )
    return incoming.join(known, "finding_id", "left").withColumn("reason", reason).drop("__known")


def split_intake(incoming: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) feedback."""
    checked = check_intake(incoming, findings)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def false_positive_rate() -> Column:
    fp = F.count_if(F.col("feedback_type") == "false_positive").cast("double")
    return F.coalesce(F.try_divide(fp, F.count("*")), F.lit(0.0))


def stats(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals per kind and the false-positive rate, in one pass."""
    return judged.groupBy(*(by or [])).agg(
        F.count("*").alias("total_feedback"),
        *[F.count_if(F.col("feedback_type") == t).alias(f"{t}s") for t in FEEDBACK_TYPES],
        false_positive_rate().alias("false_positive_rate"),
    )


def stats_by_rule(judged: DataFrame) -> DataFrame:
    """Feedback per rule from per-finding counts (``metrics.judged_findings``)."""
    fp = F.sum("false_positives")
    return judged.groupBy("rule_id").agg(
        F.sum("total_feedback").alias("total_feedback"),
        fp.alias("false_positives"),
        F.coalesce(F.try_divide(fp.cast("double"), F.sum("total_feedback")), F.lit(0.0)).alias("false_positive_rate"),
    )


def recent(feedback: DataFrame, limit: int = 10, feedback_type: str | None = None) -> DataFrame:
    """Newest feedback first; ties by highest id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = feedback if feedback_type is None else feedback.where(F.col("feedback_type") == feedback_type)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_for_rule(judged: DataFrame, rule_id: str, limit: int = 10) -> DataFrame:
    return recent(judged.where(F.col("rule_id") == rule_id), limit)


def mark_false_positives(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Set ``false_positive_marked`` on findings that any user called a false positive."""
    marked = (
        feedback.where("feedback_type = 'false_positive'")
        .select(F.col("finding_id").alias("id"), F.lit(True).alias("__fp"))
        .distinct()
    )
    return (
        findings.drop("false_positive_marked")
        .join(marked, "id", "left")
        .withColumn("false_positive_marked", F.coalesce("__fp", F.lit(False)))
        .drop("__fp")
    )
