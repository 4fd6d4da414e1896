"""Custom rules: listing, validation, change, import, export and application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.schemas import RULE_LANGUAGES, RULE_TOOLS

EXPORT_COLUMNS = [
    "name",
    "language",
    "tool",
    "rule_id",
    "enabled",
    "severity_override",
    "custom_message",
    "description",
]
PATCHABLE = ["enabled", "severity_override", "custom_message", "description"]


def list_rules(
    rules: DataFrame, language: str | None = None, tool: str | None = None, enabled: bool | None = None
) -> DataFrame:
    for column, wanted in (("language", language), ("tool", tool), ("enabled", enabled)):
        if wanted is not None:
            rules = rules.where(F.col(column) == F.lit(wanted))
    return rules


def page(rules: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of rules by id."""
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("skip must be >= 0 and limit between 1 and 1000")
    return rules.orderBy("id").offset(skip).limit(limit)


def export_rules(rules: DataFrame, language: str | None = None, tool: str | None = None) -> DataFrame:
    return list_rules(rules, language, tool).select(*EXPORT_COLUMNS)


def _known_pairs(existing: DataFrame) -> DataFrame:
    return existing.select("tool", "rule_id").distinct().withColumn("__exists", F.lit(True))


def check_new_rules(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Each incoming rule with ``reason``: null if it may be created."""
    reason = (
        F.when(~F.col("language").isin(RULE_LANGUAGES), F.lit("invalid language"))
        .when(~F.col("tool").isin(RULE_TOOLS), F.lit("invalid tool"))
        .when(
            F.col("__exists"),
            F.concat(F.lit("Rule "), F.col("tool"), F.lit(":"), F.col("rule_id"), F.lit(" already exists")),
        )
    )
    return (
        incoming.join(_known_pairs(existing), ["tool", "rule_id"], "left")
        .withColumn("reason", reason)
        .drop("__exists")
    )


def check_import(incoming: DataFrame, existing: DataFrame, dedupe_batch: bool = False) -> DataFrame:
    """Bulk import only rejects pairs already stored; ``dedupe_batch`` also keeps the first of a batch."""
    exists = F.coalesce(F.col("__exists"), F.lit(False))
    checked = incoming.join(_known_pairs(existing), ["tool", "rule_id"], "left")
    if dedupe_batch:
        first = F.row_number().over(Window.partitionBy("tool", "rule_id").orderBy("ord")) > 1
        checked = checked.withColumn("__dup", first)
        exists = exists | F.col("__dup")
    message = F.concat(F.lit("Rule "), F.col("tool"), F.lit(":"), F.col("rule_id"), F.lit(" already exists"))
    return checked.withColumn("error", F.when(exists, message)).drop("__exists", "__dup")


def import_rules(incoming: DataFrame, existing: DataFrame, dedupe_batch: bool = False) -> DataFrame:
    """The rule table after the import."""
    accepted = check_import(incoming, existing, dedupe_batch).where("error IS NULL")
    return existing.select(*EXPORT_COLUMNS).unionByName(accepted.select(*EXPORT_COLUMNS))


def import_summary(checked: DataFrame, max_errors: int = 10) -> DataFrame:
    """Counts and the first errors as one row.

    The errors are cut to ``max_errors`` by a sorted limit before they are collected, so the
    single final row holds a bounded list whatever the size of the import.
    """
    counts = checked.agg(
        F.count_if(F.col("error").isNull()).alias("imported"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.lit(None).cast("struct<ord:bigint,error:string>").alias("e"),
    )
    first = (
        checked.where("error IS NOT NULL")
        .orderBy("ord")
        .limit(max_errors)
        .select(
            F.lit(0).cast("long").alias("imported"),
            F.lit(0).cast("long").alias("failed"),
            F.struct(F.col("ord").cast("long").alias("ord"), "error").alias("e"),
        )
    )
    return counts.unionByName(first).agg(
        F.sum("imported").alias("imported"),
        F.sum("failed").alias("failed"),
        F.transform(F.array_sort(F.collect_list("e")), lambda s: s["error"]).alias("errors"),
    )


def update_rules(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply patches ``(id, fields array<string>, <values>, updated_at)``; only named fields change."""
    patch = patches.select(
        "id", "fields", F.col("updated_at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in PATCHABLE]
    )
    joined = rules.join(patch, "id", "left")
    for c in PATCHABLE:
        joined = joined.withColumn(
            c, F.when(F.array_contains("fields", c), F.col(f"__{c}")).otherwise(F.col(c))
        )
    if "updated_at" in rules.columns:
        joined = joined.withColumn("updated_at", F.coalesce("__at", "updated_at"))
    return joined.select(*rules.columns)


def missing_ids(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked-for ids that no rule has."""
    return ids.join(rules.select("id"), "id", "left_anti")


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("id"), "id", "left_anti")


def apply_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop findings of disabled rules and apply severity and message overrides.

    The rule side is left to the optimizer: it is broadcast only while it is below the
    session's size threshold and shuffled otherwise.
    """
    own = rules.select(
        "tool",
        "rule_id",
        F.col("enabled").alias("__enabled"),
        F.col("severity_override").alias("__severity"),
        F.col("custom_message").alias("__message"),
    )
    return (
        findings.join(own, ["tool", "rule_id"], "left")
        .where(F.coalesce("__enabled", F.lit(True)))
        .withColumn("severity", F.coalesce("__severity", "severity"))
        .withColumn("description", F.coalesce("__message", "description"))
        .select(*findings.columns)
    )
