"""Removal of secrets and personal data from text, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Secret patterns in the order they are applied. ``(?i)`` is widened to
# ``(?iU)`` when compiled for the JVM so that \s and letter case are Unicode-aware.
SECRET_PATTERNS = [
    ("API_KEY", r"""(?i)(api[_-]?key|apikey)[\s]*[=:]\s*["']([a-zA-Z0-9_\-]{20,})["']"""),
    ("SECRET_KEY", r"""(?i)(secret[_-]?key|secretkey)[\s]*[=:]\s*["']([a-zA-Z0-9_\-]{20,})["']"""),
    ("AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}"),
    ("AWS_SECRET_KEY", r"""(?i)aws[_-]?secret[_-]?access[_-]?key[\s]*[=:]\s*["']([a-zA-Z0-9/+=]{40})["']"""),
    ("GITHUB_TOKEN", r"ghp_[a-zA-Z0-9]{36}"),
    ("GITHUB_OAUTH_TOKEN", r"gho_[a-zA-Z0-9]{36}"),
    ("PRIVATE_KEY", r"-----BEGIN (RSA |DSA |EC )?PRIVATE KEY-----"),
    ("AUTH_TOKEN", r"""(?i)(bearer|token)[\s]*[=:]\s*["']([a-zA-Z0-9_\-\.]{20,})["']"""),
    ("DATABASE_URL", r"(?i)(postgres|mysql|mongodb)://[^:]+:[^@]+@[^/]+"),
    ("JWT_TOKEN", r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*"),
]
# What every text with a secret must contain; one scan that spares clean text the ten.
SECRET_HINT = r"""[=:][\s\u0085\p{Z}]*["']|AKIA|gh[po]_|-----BEGIN |://|eyJ"""

# Opt-in additions: URL schemes the fixed list leaves out.
EXTENDED_SECRET_PATTERNS = [
    ("DATABASE_URL", r"(?i)(postgresql|mariadb|redis|mongodb\+srv)://[^:]*:[^@]+@[^/\s]+"),
]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def luhn_ok(number: Column) -> Column:
    """Luhn check of a digit string that may hold spaces and dashes."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[ -]", ""), ""))
    values = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def iban_ok(code: Column) -> Column:
    """Mod-97 check of an IBAN."""
    turned = F.split(F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4)), "")

    def step(acc: Column, ch: Column) -> Column:
        letter = F.ascii(ch) >= 65
        value = F.when(letter, F.ascii(ch) - 55).otherwise(F.ascii(ch) - 48)
        return (acc * F.when(letter, 100).otherwise(10) + value) % 97

    return F.aggregate(turned, F.lit(0), step) == 1


@dataclass(frozen=True)
class PersonalKind:
    """A kind of personal data found by pattern: its placeholder, score and extra check."""

    name: str
    pattern: str
    placeholder: str
    score: float
    check: Callable[[Column], Column] | None = None
    needs: str | None = None


PERSONAL_KINDS = [
    PersonalKind(
        "EMAIL_ADDRESS",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        "<EMAIL_REDACTED>",
        1.0,
        needs="@",
    ),
    PersonalKind("URL", r"""https?://[^\s<>"']+""", "<PII_REDACTED>", 0.6, needs="://"),
    PersonalKind("CREDIT_CARD", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", "<PII_REDACTED>", 1.0, luhn_ok),
    PersonalKind("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "<PII_REDACTED>", 1.0, iban_ok),
    PersonalKind("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "<PII_REDACTED>", 0.5),
    PersonalKind("IP_ADDRESS", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", "<IP_REDACTED>", 0.6),
    PersonalKind(
        "PHONE_NUMBER",
        r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b",
        "<PHONE_REDACTED>",
        0.4,
    ),
]
# What every card, account, social-security, network or phone number contains.
DIGITS_HINT = r"[0-9][ .-]?[0-9]"
HIGH_CONFIDENCE = 0.7


def jvm(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iU)", 1) if pattern.startswith("(?i)") else pattern


def _pieces(text: Column, pattern: Column | str) -> tuple[Column, Column]:
    """Text between the matches, and the matches; one more piece than matches."""
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.split(text, regex, F.lit(-1)), F.regexp_extract_all(text, regex, F.lit(0))


def _present(text: Column, kind: PersonalKind) -> Column:
    """Whether the kind's pattern occurs, asking for its needed literal first."""
    hit = F.rlike(text, F.lit(kind.pattern))
    return F.contains(text, F.lit(kind.needs)) & hit if kind.needs else hit


def replace_checked(text: Column, kind: PersonalKind) -> Column:
    """Replace every match that passes the kind's check, leaving others as they are."""
    if kind.check is None:
        replaced = F.regexp_replace(text, kind.pattern, kind.placeholder)
        return F.when(F.contains(text, F.lit(kind.needs)), replaced).otherwise(text) if kind.needs else replaced
    between, found = _pieces(text, kind.pattern)
    cleaned = F.transform(
        found, lambda m: F.when(kind.check(m), F.lit(kind.placeholder)).otherwise(m)
    )
    woven = F.zip_with(between, cleaned, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.when(F.rlike(text, F.lit(kind.pattern)), F.array_join(woven, "")).otherwise(text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it.

    A stage that reads its input several times must not have that input substituted into
    it: filters pushed below a projection would copy the whole chain again at every stage.
    """
    return F.transform(F.array(value), use)[0]


def redact_secrets(text: Column, extended: bool = False) -> Column:
    """Each secret pattern in turn, whole match replaced by ``<TYPE_REDACTED>``."""
    patterns = SECRET_PATTERNS + (EXTENDED_SECRET_PATTERNS if extended else [])
    out = text
    for name, pattern in patterns:
        out = F.regexp_replace(out, jvm(pattern), f"<{name}_REDACTED>")
    return F.when(F.rlike(text, F.lit(SECRET_HINT)), out).otherwise(text)


def _plain(text: Column, kinds: list[PersonalKind]) -> Column:
    for kind in kinds:
        text = F.regexp_replace(text, kind.pattern, kind.placeholder)
    return text


def _checked_stage(kind: PersonalKind) -> Callable[[Column], Column]:
    return lambda text: replace_checked(text, kind)


def _grouped(kinds: list[PersonalKind]) -> list[list[PersonalKind]]:
    """Kinds in order, neighbours without a check together."""
    groups: list[list[PersonalKind]] = []
    for kind in kinds:
        if groups and kind.check is None and groups[-1][0].check is None:
            groups[-1].append(kind)
        else:
            groups.append([kind])
    return groups


# Kinds found by a literal come first in the list, those made of digits after them.
_BY_LITERAL = [k for k in PERSONAL_KINDS if k.needs is not None]
_BY_DIGITS = [k for k in PERSONAL_KINDS if k.needs is None]


def _has_literal(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k.needs)) for k in _BY_LITERAL])


def _has_digits(text: Column) -> Column:
    return F.rlike(text, F.lit(DIGITS_HINT))


def redact_text(text: Column, extended: bool = False) -> Column:
    """Text without secrets and personal data.

    Three cheap scans (for what secrets, addresses and numbers must contain) decide which
    of the pattern groups run on a text at all.
    """

    def digits(v: Column) -> Column:
        out = v
        for kinds in _grouped(_BY_DIGITS):
            out = bind(out, _checked_stage(kinds[0])) if kinds[0].check else _plain(out, kinds)
        return F.when(_has_digits(v), out).otherwise(v)

    out = bind(text, lambda v: redact_secrets(v, extended))
    out = bind(out, lambda v: F.when(_has_literal(v), _plain(v, _BY_LITERAL)).otherwise(v))
    return bind(out, digits)


def add_redacted(df: DataFrame, source: str, out: str, extended: bool = False) -> DataFrame:
    """Add ``out``: ``source`` without secrets and personal data."""
    return df.withColumn(out, redact_text(F.col(source), extended))


def redact_path(path: Column) -> Column:
    """User names in home-directory paths."""
    # The three home-directory forms.
    for pattern, replacement in (
        (r"/Users/[^/]+/", "/Users/<USERNAME>/"),
        (r"/home/[^/]+/", "/home/<USERNAME>/"),
        (r"C:\\Users\\[^\\]+\\", r"C:\\Users\\<USERNAME>\\"),
    ):
        path = F.regexp_replace(path, pattern, replacement)
    return path


def is_clean(text: Column) -> Column:
    """True iff no secret pattern and no high-confidence personal data is left."""
    secret = reduce(lambda a, b: a | b, [F.rlike(text, F.lit(jvm(p))) for _, p in SECRET_PATTERNS])
    dirty = F.rlike(text, F.lit(SECRET_HINT)) & secret
    for kind in PERSONAL_KINDS:
        if kind.score <= HIGH_CONFIDENCE:
            continue
        if kind.check is None:
            dirty = dirty | _present(text, kind)
        else:
            found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
            dirty = dirty | (_has_digits(text) & F.exists(found, kind.check))
    return ~F.coalesce(dirty, F.lit(False))


def _starts(text: Column, pattern: Column) -> Column:
    """0-based start of every match: what stands before it, pieces and earlier matches."""
    between, found = _pieces(text, pattern)
    grown = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m")),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts")),
        lambda acc, z: F.struct(
            (acc["pos"] + F.length(z["b"]) + F.length(z["m"])).alias("pos"),
            F.concat(acc["starts"], F.array(acc["pos"] + F.length(z["b"]))).alias("starts"),
        ),
    )
    return grown["starts"]


_LOG_TYPE = "array<struct<type:string,field:string,position:int,score:double>>"


def _entry(name: Column, field: str, position: Column, score: Column) -> Column:
    return F.struct(
        name.alias("type"),
        F.lit(field).alias("field"),
        position.cast("int").alias("position"),
        score.cast("double").alias("score"),
    )


def _fold(state: Column, steps: list[tuple[str, str, str, float | None]], field: str) -> Column:
    """Apply ``(type, pattern, placeholder, score)`` steps in order to ``struct<text, log>``.

    A fold over an array of patterns keeps the expression flat; the patterns are compiled
    per row, so it is meant for the few rows that hold something to redact.
    """
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(pattern).alias("pattern"),
                F.lit(placeholder).alias("placeholder"),
                F.lit(score).cast("double").alias("score"),
            )
            for name, pattern, placeholder, score in steps
        ]
    )

    def step(acc: Column, rule: Column) -> Column:
        secret = rule["score"].isNull()
        entries = F.transform(
            _starts(acc["text"], rule["pattern"]),
            lambda start: _entry(rule["name"], field, F.when(secret, start), rule["score"]),
        )
        return F.struct(
            F.regexp_replace(acc["text"], rule["pattern"], rule["placeholder"]).alias("text"),
            F.concat(acc["log"], entries).alias("log"),
        )

    return F.aggregate(rules, state, step)


def _logged_check(kind: PersonalKind, field: str) -> Callable[[Column], Column]:
    def step(state: Column) -> Column:
        found = F.filter(F.regexp_extract_all(state["text"], F.lit(kind.pattern), F.lit(0)), kind.check)
        entry = _entry(F.lit(kind.name), field, F.lit(None), F.lit(kind.score))
        changed = F.struct(
            replace_checked(state["text"], kind).alias("text"),
            F.concat(state["log"], F.transform(found, lambda _: entry)).alias("log"),
        )
        return F.when(F.rlike(state["text"], F.lit(kind.pattern)), changed).otherwise(state)

    return step


def add_redaction_log(df: DataFrame, source: str, field: str, out: str, log: str) -> DataFrame:
    """Add the redacted text and one log entry per replacement.

    Secrets carry the position of the match in the text as it was when their pattern ran;
    personal data carries the score of its kind.
    """
    secrets = [(name, jvm(pattern), f"<{name}_REDACTED>", None) for name, pattern in SECRET_PATTERNS]

    def fold_kinds(kinds: list[PersonalKind]) -> Callable[[Column], Column]:
        steps = [(k.name, k.pattern, k.placeholder, k.score) for k in kinds]
        return lambda s: _fold(s, steps, field)

    def digits(start: Column) -> Column:
        state = start
        for kinds in _grouped(_BY_DIGITS):
            state = bind(state, _logged_check(kinds[0], field) if kinds[0].check else fold_kinds(kinds))
        return F.when(_has_digits(start["text"]), state).otherwise(start)

    state = F.struct(F.col(source).alias("text"), F.array().cast(_LOG_TYPE).alias("log"))
    state = bind(
        state, lambda s: F.when(F.rlike(s["text"], F.lit(SECRET_HINT)), _fold(s, secrets, field)).otherwise(s)
    )
    state = bind(state, lambda s: F.when(_has_literal(s["text"]), fold_kinds(_BY_LITERAL)(s)).otherwise(s))
    state = bind(state, digits)
    kept = [F.col(c) for c in df.columns if c not in (out, log)]
    return df.select(*kept, state.alias("__state")).select(
        *kept, F.col("__state.text").alias(out), F.col("__state.log").alias(log)
    )


def redaction_counts(logged: DataFrame, log: str, by: list[str] | None = None) -> DataFrame:
    """Replacements per type.

    The outer explode keeps Spark from testing the log's size below the projection that
    makes it, which would run the patterns once more per row.
    """
    return (
        logged.select(*(by or []), F.explode_outer(log).alias("entry"))
        .where("entry IS NOT NULL")
        .groupBy(*(by or []), F.col("entry.type").alias("type"))
        .agg(F.count("*").alias("replacements"))
    )


def sanitize_findings(findings: DataFrame) -> DataFrame:
    """Clean the snippet, the context code, each import and both paths; absent fields stay absent."""
    cleaned = {"file_path": redact_path(F.col("file_path"))}
    if "code_snippet" in findings.columns:
        cleaned["code_snippet"] = redact_text(F.col("code_snippet"))
    if "context" in findings.columns:
        context = (
            F.col("context")
            .withField("context_code", redact_text(F.col("context.context_code")))
            .withField("imports", F.transform("context.imports", lambda line: redact_text(line)))
            .withField("file", redact_path(F.col("context.file")))
        )
        cleaned["context"] = F.when(F.col("context").isNotNull(), context)
    return findings.withColumns(cleaned)
