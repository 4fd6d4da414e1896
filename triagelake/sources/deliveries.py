"""Webhook deliveries: parse the body, check the signature, decide what to scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.digest import signature_ok

BODY_DDL = (
    "action string, ref string, after string, "
    "pull_request struct<number:int,head:struct<sha:string>>, repository struct<full_name:string>"
)

# Fixed values.
SCANNED_ACTIONS = ["opened", "synchronize"]
SCANNED_REFS = ["refs/heads/main", "refs/heads/master"]


def parse(deliveries: DataFrame) -> DataFrame:
    """Body fields of ``(delivery_id, event, body, …)``."""
    parsed = deliveries.withColumn("b", F.from_json("body", BODY_DDL, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}))
    return parsed.select(
        *[F.col(c) for c in deliveries.columns],
        F.col("b.action").alias("action"),
        F.col("b.ref").alias("ref"),
        F.col("b.repository.full_name").alias("repo_full_name"),
        F.col("b.pull_request.number").alias("pr_number"),
        F.coalesce("b.pull_request.head.sha", "b.after").alias("commit_sha"),
    )


def route(parsed: DataFrame) -> DataFrame:
    """Add ``queued`` and the ``message`` that answers the delivery."""
    is_pr, is_push = F.col("event") == "pull_request", F.col("event") == "push"
    queued = (is_pr & F.col("action").isin(SCANNED_ACTIONS)) | (is_push & F.col("ref").isin(SCANNED_REFS))
    none = F.lit("None")
    message = (
        F.when(F.col("queued"), "Scan queued")
        .when(is_pr, F.concat(F.lit("PR action "), F.coalesce("action", none), F.lit(" ignored")))
        .when(is_push, F.concat(F.lit("Push to "), F.coalesce("ref", none), F.lit(" ignored")))
        .when(F.col("event") == "ping", "pong")
        .otherwise(F.concat(F.lit("Event "), F.coalesce("event", none), F.lit(" not handled")))
    )
    return parsed.withColumn("queued", F.coalesce(queued, F.lit(False))).withColumn("message", message)


def scan_queue(deliveries: DataFrame, secret: str | None = None) -> DataFrame:
    """Scan jobs asked for by valid deliveries; works on batch and streaming frames alike."""
    checked = deliveries
    if secret:
        checked = deliveries.where(signature_ok(F.col("body"), F.col("signature"), secret))
    keep = [c for c in ("delivery_id", "received_at") if c in deliveries.columns]
    return (
        route(parse(checked))
        .where("queued")
        .select(*keep, "event", "repo_full_name", "pr_number", "commit_sha", F.lit("pending").alias("status"))
    )
