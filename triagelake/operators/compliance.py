"""SOC2, GDPR and HIPAA reports per project."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.ordered import first_n

REPORT_VERSION = "1.0"
LISTED_FINDINGS = 10


@dataclass(frozen=True)
class Standard:
    """What one report looks for: categories by keyword, and how the score falls."""

    name: str
    categories: dict[str, list[str]]
    penalties: list[tuple[str, int]]
    passing: int
    recommendations: dict[str, list[str]]
    listed: dict[str, str] = field(default_factory=dict)


# Keywords, penalties, pass marks and recommendation lists of each report.
SOC2 = Standard(
    name="SOC2",
    categories={
        "security": ["injection", "xss", "csrf", "auth", "crypto"],
        "confidentiality": ["secret", "password", "key", "token", "credential"],
        "privacy": ["pii", "personal", "gdpr", "privacy"],
    },
    penalties=[("critical_findings", 10), ("high_findings", 5)],
    passing=80,
    recommendations={
        "security": ["Implement secure coding practices to address security vulnerabilities"],
        "confidentiality": ["Implement secrets management and encryption for sensitive data"],
        "privacy": ["Implement privacy controls and data protection measures"],
    },
    listed={"security": "security", "confidentiality": "confidentiality", "privacy": "privacy"},
)
GDPR = Standard(
    name="GDPR",
    categories={
        "pii": ["pii", "personal", "email", "phone", "address"],
        "encryption": ["encrypt", "crypto", "hash"],
        "access_control": ["auth", "access", "permission", "rbac"],
    },
    penalties=[("severe_pii_findings", 15)],
    passing=85,
    recommendations={
        "pii": [
            "Implement data minimization principles",
            "Add encryption for personal data at rest and in transit",
            "Implement access controls for PII",
            "Add audit logging for PII access",
            "Implement data retention policies",
        ]
    },
    listed={"pii": "data_protection", "encryption": "encryption", "access_control": "access_control"},
)
HIPAA = Standard(
    name="HIPAA",
    categories={
        "phi": ["phi", "health", "medical", "patient"],
        "encryption": ["encrypt", "crypto", "tls", "ssl"],
        "audit": ["log", "audit", "track"],
    },
    penalties=[("phi_findings", 20)],
    passing=90,
    recommendations={
        "phi": [
            "Implement encryption for PHI at rest and in transit",
            "Add role-based access controls (RBAC) for PHI",
            "Implement comprehensive audit logging",
            "Add automatic session timeout",
            "Implement data backup and disaster recovery",
        ]
    },
)
STANDARDS = {s.name: s for s in (SOC2, GDPR, HIPAA)}


def standard(name: str) -> Standard:
    """Report choice by name, ignoring case."""
    if name.upper() not in STANDARDS:
        raise ValueError(f"Unknown report type: {name}")
    return STANDARDS[name.upper()]


def mentions(words: list[str]) -> Column:
    """True if the rule id or the description contains any of the words (as substrings)."""
    texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("rule_id", "description")]
    return reduce(lambda a, b: a | b, [t.contains(w) for w in words for t in texts])


def classified(findings: DataFrame, std: Standard) -> DataFrame:
    """Findings with one boolean per category; a finding may be in several."""
    return findings.withColumns({f"in_{c}": mentions(words) for c, words in std.categories.items()})


def _verdict(count: Column) -> Column:
    return F.when(count == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))


def summary(findings: DataFrame, report_type: str = "SOC2", project: str | None = None) -> DataFrame:
    """Counts, score, status, per-category verdicts and recommendations, one row per project."""
    std = standard(report_type)
    rows = classified(findings, std)
    counts = [F.count_if(F.col(f"in_{c}")).alias(f"{c}_findings") for c in std.categories]
    counts += [
        F.count("*").alias("total_findings"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_findings"),
        F.count_if(F.col("severity") == "HIGH").alias("high_findings"),
        F.count_if(F.lower(F.coalesce("rule_id", F.lit(""))).contains("auth")).alias("auth_rule_findings"),
    ]
    if "pii" in std.categories:
        severe = F.col("in_pii") & F.col("severity").isin("CRITICAL", "HIGH")
        counts.append(F.count_if(severe).alias("severe_pii_findings"))
    out = rows.groupBy(*([project] if project else [])).agg(*counts)
    loss = reduce(lambda a, b: a + b, [F.col(c) * weight for c, weight in std.penalties])
    out = out.withColumn("compliance_score", F.greatest(F.lit(0), F.lit(100) - loss))
    out = out.withColumn(
        "status", F.when(F.col("compliance_score") >= std.passing, "COMPLIANT").otherwise("NON_COMPLIANT")
    )
    out = out.withColumns({f"{c}_status": _verdict(F.col(f"{c}_findings")) for c in std.categories})
    if std is HIPAA:
        out = out.withColumn("access_control_status", _verdict(F.col("auth_rule_findings")))
    advice = F.concat(
        *[
            F.when(F.col(f"{c}_findings") > 0, F.array(*[F.lit(x) for x in texts])).otherwise(
                F.array().cast("array<string>")
            )
            for c, texts in std.recommendations.items()
        ]
    )
    return out.withColumn("recommendations", advice).withColumn("report_type", F.lit(std.name))


def listed_findings(
    findings: DataFrame, report_type: str, project: str, order: list[str], n: int = LISTED_FINDINGS
) -> DataFrame:
    """The first ``n`` findings of each category and project, from one pass over the findings."""
    std = standard(report_type)
    rows = classified(findings, std)
    hits = F.array_compact(F.array(*[F.when(F.col(f"in_{c}"), F.lit(c)) for c in std.categories]))
    tagged = rows.withColumn("category_name", F.explode(hits)).drop(*[f"in_{c}" for c in std.categories])
    return first_n(tagged, [project, "category_name"], [F.col(c) for c in order], n, "position")


def report(
    findings: DataFrame, report_type: str, project: str, order: list[str], generated_at: Column | None = None
) -> DataFrame:
    """One JSON document per project; each document lists at most ten findings per category."""
    std = standard(report_type)
    head = summary(findings, report_type, project)
    fields = ["rule_id", "severity", "description", "file_path", "line_number", "tool"]
    fields = [c for c in fields if c in findings.columns]
    lists = (
        listed_findings(findings, report_type, project, order)
        .groupBy(F.col(project).alias("__p"))
        .agg(
            *[
                F.array_sort(
                    F.collect_list(
                        F.when(F.col("category_name") == c, F.struct("position", *[F.col(f) for f in fields]))
                    )
                ).alias(f"list_{c}")
                for c in std.categories
            ]
        )
    )
    joined = head.join(lists, F.col(project).eqNullSafe(F.col("__p")), "left")
    if std is HIPAA:
        detail = F.struct(
            F.struct(
                F.col("encryption_status").alias("encryption"),
                F.col("access_control_status").alias("access_control"),
            ).alias("technical"),
            F.struct(F.col("audit_status").alias("audit_controls")).alias("administrative"),
        ).alias("safeguards")
        counted = [f"{c}_findings" for c in std.categories]
    else:
        detail = F.struct(
            *[
                F.struct(
                    F.col(f"{c}_status").alias("status"),
                    F.col(f"{c}_findings").alias("findings_count"),
                    F.transform(
                        F.col(f"list_{c}"), lambda s: F.struct(*[s[f].alias(f) for f in fields])
                    ).alias("findings"),
                ).alias(label)
                for c, label in std.listed.items()
            ]
        ).alias("principles" if std is SOC2 else "requirements")
        counted = [f"{c}_findings" for c in std.categories]
        if std is SOC2:
            counted = ["total_findings", "critical_findings", "high_findings", *counted]
    document = F.to_json(
        F.struct(
            F.lit(std.name).alias("report_type"),
            F.lit(REPORT_VERSION).alias("version"),
            (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
            F.col(project).alias("project_name"),
            "compliance_score",
            "status",
            F.struct(*counted).alias("summary"),
            detail,
            "recommendations",
        )
    )
    return joined.select(F.col(project), "compliance_score", "status", document.alias("report"))
