"""Hashes: cache keys, content hashes, signature check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def response_key(code: Column, rule_id: Column) -> Column:
    """Short key of a reviewed snippet: ``llm:`` and 16 hex digits."""
    text = F.concat(F.coalesce(code, F.lit("")), F.lit(":"), F.coalesce(rule_id, F.lit("")))
    return F.concat(F.lit("llm:"), F.substring(F.sha2(text, 256), 1, 16))


def scan_key(path: Column, file_hash: Column) -> Column:
    """Short key of a scanned file: ``scan:`` and 16 hex digits."""
    return F.concat(
        F.lit("scan:"), F.substring(F.sha2(F.concat(path, F.lit(":"), file_hash), 256), 1, 16)
    )


def request_key(system: Column, user: Column, model: Column, temperature: Column) -> Column:
    """Key of a whole review request: hash of its canonical JSON, fields in sorted order."""

    def message(role: str, content: Column) -> Column:
        return F.struct(content.alias("content"), F.lit(role).alias("role"))

    canonical = F.to_json(
        F.struct(
            F.array(message("system", system), message("user", user)).alias("messages"),
            model.alias("model"),
            F.bround(temperature.cast("double"), 2).alias("temperature"),
        )
    )
    return F.concat(F.lit("llm_cache:"), model, F.lit(":"), F.sha2(canonical, 256))


def hmac_sha256_hex(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text, as two nested hashes over pads made once on the driver."""
    import hashlib

    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def signature_ok(body: Column, signature: Column, secret: str | None) -> Column:
    """True if ``signature`` is ``sha256=`` and the body's HMAC; no secret accepts all, no header none."""
    if not secret:
        return F.lit(True)
    given = F.split(signature, "=")[1]
    ok = signature.startswith("sha256=") & (given == hmac_sha256_hex(body, secret))
    return F.coalesce(ok, F.lit(False))
