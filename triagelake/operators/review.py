"""Review of findings by a pluggable completer, with cache, validation and fallback."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import digest, prompts
from triagelake.operators import cache
from triagelake.operators.costs import with_cost
from triagelake.schemas import VERDICT_SEVERITIES, VERDICTS

VERDICT_DDL = (
    "decision string, confidence double, reasoning string, severity string, exploitability string, "
    "remediation string, false_positive_reason string, cwe_ids array<string>"
)
VERDICT_FIELDS = [f.split(" ")[0] for f in VERDICT_DDL.split(", ")]

# Length limits of a verdict's texts.
REASONING_CHARS = (10, 500)
MAX_CHARS = {"exploitability": 200, "remediation": 300, "false_positive_reason": 200}
TEMPERATURE = 0.1
BATCH = 5

#: Takes prompts, returns one response text per prompt (None on failure).
Completer = Callable[[list[str]], list[str | None]]


def verdict_problems(v: Column) -> Column:
    """Names of the fields that break the verdict's rules; empty if it is valid."""
    checks = {
        "decision": F.coalesce(v["decision"].isin(VERDICTS), F.lit(False)),
        "confidence": F.coalesce(v["confidence"].between(0.0, 1.0), F.lit(False)),
        "reasoning": F.coalesce(F.length(v["reasoning"]).between(*REASONING_CHARS), F.lit(False)),
        "severity": v["severity"].isNull() | v["severity"].isin(VERDICT_SEVERITIES),
        **{f: v[f].isNull() | (F.length(v[f]) <= n) for f, n in MAX_CHARS.items()},
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))


def _one_object(text: Column) -> Column:
    """The verdict's fields if the text is exactly one JSON object, else null.

    The reader stops after the first value. Text that stands both as a list's only element
    and as a field's value has nothing behind its object. A number may be written as a string.
    """
    ddl = VERDICT_DDL.replace("confidence double", "confidence string")
    strict = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{ddl}>>", strict)
    field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v struct<{ddl}>", strict)["v"]
    confidence = field["confidence"].try_cast("double").alias("confidence")
    fields = [confidence if f == "confidence" else field[f].alias(f) for f in VERDICT_FIELDS]
    return F.when((F.size(listed) == 1) & field.isNotNull(), F.struct(*fields))


def parse_verdicts(responses: DataFrame, content: str = "content") -> DataFrame:
    """Responses with their verdict columns; an invalid one becomes ``uncertain`` with confidence 0."""
    parsed = responses.withColumn("v", _one_object(F.col(content)))
    parsed = parsed.withColumn("problems", verdict_problems(F.col("v")))
    ok = F.size("problems") == 0
    failed = {
        "decision": F.lit("uncertain"),
        "confidence": F.lit(0.0),
        "reasoning": F.concat(F.lit("Verification failed due to error: invalid "), F.array_join("problems", ", ")),
    }
    out = [F.when(ok, F.col(f"v.{f}")).otherwise(failed.get(f, F.lit(None))).alias(f) for f in VERDICT_FIELDS]
    kept = [F.col(c) for c in responses.columns]
    return parsed.select(*kept, ok.alias("valid"), *out)


def _complete(complete: Completer, batch: int, prefix: str, in_flight: int):
    def call(texts: list[str]) -> list[str | None]:
        try:
            return complete(texts)
        except Exception:  # what a model service may raise is not known here; its rows become uncertain
            return [None] * len(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                fresh = frame["content"].isna()
                texts = [prefix + text for text in frame.loc[fresh, "prompt"]]
                # map() gives the answers in order, whichever call ends first.
                calls = pool.map(call, (texts[i : i + batch] for i in range(0, len(texts), batch)))
                answers = [answer for own in calls for answer in own]
                out = pd.DataFrame({"key": frame["key"], "content": frame["content"].astype(object), "fresh": fresh})
                out["prompt_chars"] = 0
                out.loc[fresh, "content"] = answers
                out.loc[fresh, "prompt_chars"] = [len(text) for text in texts]
                yield out

    return run


def complete_prompts(
    asked: DataFrame, complete: Completer, batch: int = 1, parallel: int | None = None, prefix: str = "", in_flight: int = BATCH
) -> DataFrame:
    """``(key, prompt[, content])`` → ``(key, content, fresh, prompt_chars)``, ``batch`` prompts per call.

    A task has up to ``in_flight`` calls open at once; a call that raises leaves its own rows without
    content, which makes their verdicts uncertain. Rows that already have content pass through. ``parallel`` bounds how many tasks call the
    completer at once; ``prefix`` is put before every prompt on the Python side, so that a
    long constant text is not moved with each row.
    """
    if "content" not in asked.columns:
        asked = asked.withColumn("content", F.lit(None).cast("string"))
    if parallel is not None:
        asked = asked.repartition(parallel, "key")
    return asked.select("key", "prompt", "content").mapInPandas(
        _complete(complete, batch, prefix, in_flight), "key string, content string, fresh boolean, prompt_chars long"
    )


def _fixed_text(with_examples: bool) -> str:
    return prompts.EXAMPLES_TEXT + prompts.EXAMPLES_SEPARATOR if with_examples else ""


def requests_of(findings: DataFrame, model: str, with_examples: bool = True) -> DataFrame:
    """Findings' request columns with their cache ``key``.

    The constant texts enter the key by their hash, so that only what differs is hashed per row.
    """
    constant = hashlib.sha256((prompts.SYSTEM_TEXT + _fixed_text(with_examples)).encode()).hexdigest()
    prompt = prompts.review_prompt(with_examples=False)
    key = digest.request_key(F.lit(constant), prompt, F.lit(model), F.lit(TEMPERATURE))
    return prompts.review_request(findings).withColumn("key", key)


def review(
    findings: DataFrame,
    snapshot: DataFrame,
    complete: Completer,
    model: str = "gpt-4o",
    now: Column | None = None,
    with_examples: bool = True,
    parallel: int | None = None,
    responses_path: str | None = None,
) -> DataFrame:
    """Verdict per finding: cached response if alive, else the completer's, validated.

    Equal requests are asked once: they are made distinct by key before anything else is
    done, and the prompt text is built after that shuffle. ``snapshot`` holds one entry per
    key (as :func:`cache.put` leaves it). Distinct requests meet the cache
    in one join; only those without a response are sent to the completer. Filters and
    caps on findings belong before this call, since nothing is pushed through it. With
    ``responses_path`` (a folder all executors share) the responses are stored there before
    they are used: a lost executor then never causes a paid call to be made again, and the
    folder's ``fresh`` rows feed :func:`cache_entries` and :func:`call_records`.
    """
    asked = requests_of(findings, model, with_examples)
    distinct = asked.drop("id").dropDuplicates(["key"])
    live = cache.live_entries(snapshot, now if now is not None else F.current_timestamp())
    known = distinct.join(live.select("key", F.col("payload").alias("content")), "key", "left")
    prompt = F.when(F.col("content").isNull(), prompts.review_prompt(with_examples=False))
    done = complete_prompts(
        known.select("key", prompt.alias("prompt"), "content"),
        complete,
        parallel=parallel,
        prefix=_fixed_text(with_examples),
    )
    if responses_path is not None:
        done.write.mode("overwrite").parquet(responses_path)
        done = findings.sparkSession.read.schema(done.schema).parquet(responses_path)
    verdicts = parse_verdicts(done.select("key", "content")).drop("content")
    return asked.select("id", "key").join(verdicts, "key", "left")


def cache_entries(fresh: DataFrame, now: Column, ttl_s: int = cache.RESPONSE_TTL) -> DataFrame:
    """Completed responses as cache entries (failed ones are not cached)."""
    valid = parse_verdicts(fresh.where("fresh")).where("valid")
    return valid.select(
        "key",
        F.lit(None).cast("string").alias("path"),
        F.col("content").alias("payload"),
        now.alias("cached_at"),
        F.lit(ttl_s).cast("long").alias("ttl_s"),
    )


def call_records(fresh: DataFrame, provider: str, model: str, now: Column) -> DataFrame:
    """Cost entries of completed calls, tokens estimated from text lengths."""
    calls = fresh.where("fresh").select(
        now.alias("timestamp"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.floor(F.col("prompt_chars") / 4).alias("input_tokens"),
        prompts.token_estimate(F.coalesce("content", F.lit(""))).alias("output_tokens"),
    )
    return with_cost(calls)
