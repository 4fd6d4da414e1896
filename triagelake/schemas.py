"""Table schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

CONTEXT_DDL = (
    "file string, target_line int, context_start_line int, context_end_line int, "
    "context_code string, context_type string, function_name string, class_name string, "
    "imports array<string>"
)

#: What every report reader produces, in column order.
REPORT_FINDING_DDL = (
    "report_id string, ord long, tool string, rule_id string, severity string, confidence string, "
    "description string, file_path string, line_number int, code_snippet string, category string, "
    "cve string, package string, version string, fixed_version string"
)

TABLE_DDL = {
    "scan_jobs": (
        "id long, repo_full_name string, pr_number int, commit_sha string, status string, "
        "started_at timestamp, completed_at timestamp, error_message string"
    ),
    "findings": (
        "id long, scan_job_id long, tool string, rule_id string, severity string, confidence string, "
        "description string, file_path string, line_number int, code_snippet string, language string, "
        "category string, cve string, package string, version string, fixed_version string, "
        "llm_decision string, llm_confidence double, llm_reasoning string, llm_severity string, "
        "llm_remediation string, cwe_ids array<string>, reported_to_pr boolean, "
        "false_positive_marked boolean, created_at timestamp, context struct<"
        + ", ".join(part.replace(" ", ": ", 1) for part in CONTEXT_DDL.split(", "))
        + ">"
    ),
    "custom_rules": (
        "id long, name string, language string, tool string, rule_id string, enabled boolean, "
        "severity_override string, custom_message string, description string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "rule_configurations": "key string, value string, description string, created_at timestamp, updated_at timestamp",
    "feedback": (
        "id long, finding_id long, user_github_username string, feedback_type string, "
        "comment string, created_at timestamp"
    ),
    "metric_snapshots": (
        "id long, timestamp timestamp, period string, language string, tool string, severity string, "
        "true_positives long, false_positives long, false_negatives long, true_negatives long, "
        "precision double, recall double, f1_score double, total_findings long, total_scans long"
    ),
    "audit_log": (
        "id long, timestamp timestamp, event_type string, repo_full_name string, pr_number int, details string"
    ),
    "llm_costs": (
        "timestamp timestamp, provider string, model string, input_tokens long, output_tokens long, "
        "cost_usd double, scan_id string, finding_id string"
    ),
    "verifications": (
        "finding_id long, decision string, confidence double, reasoning string, severity string, "
        "exploitability string, remediation string, false_positive_reason string, cwe_ids array<string>"
    ),
    "fix_templates": (
        "ord int, vulnerability_type string, rule_ids array<string>, languages array<string>, "
        "template string, imports_needed array<string>, explanation string"
    ),
    "fix_suggestions": (
        "finding_id long, rule_id string, file_path string, line_number int, original_code string, "
        "fixed_code string, explanation string, confidence double, imports_needed array<string>, "
        "diff string, template_used string"
    ),
    "manifest": "snapshot string, path string, hash string",
    "response_cache": "key string, path string, payload string, cached_at timestamp, ttl_s long",
    "deliveries": "delivery_id long, event string, signature string, body string, received_at timestamp",
    "metric_samples": "ts timestamp, metric string, labels map<string,string>, value double",
    "source_files": "file_path string, content string",
}


def schema_of(table: str) -> T.StructType:
    """The declared schema of one of the library's tables."""
    return T.StructType.fromDDL(TABLE_DDL[table])


# Fixed values.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "ERROR"]
VERDICTS = ["true_positive", "false_positive", "uncertain"]
VERDICT_SEVERITIES = ["critical", "high", "medium", "low", "info"]
FEEDBACK_TYPES = ["true_positive", "false_positive", "false_negative"]
RULE_LANGUAGES = ["python", "javascript", "typescript", "go", "rust"]
RULE_TOOLS = ["bandit", "eslint", "gosec", "cargo-clippy", "cargo-audit"]
DEFAULT_SCAN_LANGUAGES = ["python", "javascript", "typescript", "go", "rust"]
