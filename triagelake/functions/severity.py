"""Severity maps, ranks, gates and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DEPENDENCY_SEVERITY = {
    "CRITICAL": "HIGH",
    "HIGH": "HIGH",
    "MEDIUM": "MEDIUM",
    "MODERATE": "MEDIUM",
    "LOW": "LOW",
    "INFO": "LOW",
}
CPPCHECK_SEVERITY = {
    "error": "HIGH",
    "warning": "MEDIUM",
    "style": "LOW",
    "performance": "LOW",
    "portability": "LOW",
    "information": "INFO",
}
SPOTBUGS_PRIORITY = {"1": "HIGH", "2": "MEDIUM", "3": "LOW"}
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
GATE_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
NOTIFY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY_MARKER = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
DECISION_MARKER = {"true_positive": "🚨", "false_positive": "✅", "uncertain": "⚠️"}
EMBED_COLOR = {"CRITICAL": 0xFF0000, "HIGH": 0xFF6600, "MEDIUM": 0xFFFF00, "LOW": 0x00FF00}


def lookup(key: Column, table: dict, default) -> Column:
    """``table[key]``, or ``default`` for a missing or null key, as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def dependency_severity(severity: Column) -> Column:
    return lookup(F.upper(severity), DEPENDENCY_SEVERITY, "MEDIUM")


def sarif_level(severity: Column) -> Column:
    return lookup(F.upper(severity), SARIF_LEVEL, "warning")


def gate_rank(severity: Column) -> Column:
    return lookup(F.lower(severity), GATE_RANK, 0)


def exit_code(findings: DataFrame, fail_on: str = "critical", by: list[str] | None = None) -> DataFrame:
    """Build gate: 1 if any finding reaches the threshold, else 0."""
    keys = by or []
    if fail_on == "none":
        return findings.groupBy(*keys).agg(F.lit(0).alias("exit_code"))
    threshold = GATE_RANK.get(fail_on.lower(), 4)
    reached = F.coalesce(F.bool_or(gate_rank(F.col("severity")) >= threshold), F.lit(False))
    return findings.groupBy(*keys).agg(reached.cast("int").alias("exit_code"))


def should_notify(severity: Column, minimum: str = "HIGH") -> Column:
    """Case-sensitive threshold; an unknown severity counts as MEDIUM."""
    return lookup(severity, NOTIFY_RANK, 2) >= NOTIFY_RANK.get(minimum, 3)


def severity_marker(severity: Column) -> Column:
    return lookup(severity, SEVERITY_MARKER, "⚠️")


def decision_marker(decision: Column) -> Column:
    return lookup(decision, DECISION_MARKER, "ℹ️")


def embed_color(severity: Column) -> Column:
    return lookup(severity, EMBED_COLOR, 0xFFFF00)
