"""Fix templates, suggestions, checks, line changes and application of fixes."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions import prompts
from triagelake.functions.languages import fix_language
from triagelake.session import local_table

ACCEPTED_CONFIDENCE = 0.8
REVIEW_CONFIDENCE = 0.7
TEMPLATE_CONFIDENCE = 0.9
FREE_CONFIDENCE = 0.75

_PY, _JS, _GO, _RS = ["python"], ["javascript", "typescript"], ["go"], ["rust"]
# Kinds, rule ids, languages and imports, in matching order. Guides and
# explanations are our own words.
TEMPLATES = [
    ("weak_crypto_md5", ["B303", "B324"], _PY, "hashed = bcrypt.hashpw(secret.encode(), bcrypt.gensalt())",
     ["bcrypt"], "MD5 is broken; hash passwords with bcrypt."),
    ("weak_crypto_sha1", ["B303", "B324"], _PY, "digest = hashlib.sha256(payload).hexdigest()",
     ["hashlib"], "SHA-1 is no longer safe; take SHA-256 or stronger."),
    ("sql_injection", ["B608", "B609"], _PY, "cursor.execute('SELECT name FROM accounts WHERE key = ?', (key,))",
     [], "A parameterized statement keeps data apart from SQL."),
    ("command_injection", ["B602", "B603", "B605", "B607"], _PY, "subprocess.run(['tool', argument], check=True)",
     ["subprocess"], "An argument list without a shell leaves nothing to inject into."),
    ("hardcoded_password", ["B105", "B106"], _PY, "password = os.environ['SERVICE_PASSWORD']",
     ["os"], "Secrets belong in the environment, not in the source."),
    ("path_traversal", ["B608"], _PY, "target = (root / name).resolve()\nif root not in target.parents:\n    raise ValueError(name)",
     ["os", "pathlib.Path"], "Resolve the path and check that it stays below its root."),
    ("insecure_deserialization", ["B301", "B302", "B303"], _PY, "value = json.loads(payload)",
     ["json"], "Unpickling runs code of the sender; JSON does not."),
    ("xss", ["no-danger", "react/no-danger"], _JS, "<p>{text}</p> // or DOMPurify.sanitize(text) where markup is wanted",
     ["dompurify"], "Let React escape the text, or sanitize it with DOMPurify."),
    ("eval_usage", ["no-eval"], _JS, "const value = JSON.parse(text);",
     [], "Parse data instead of evaluating it as code."),
    ("sql_injection_js", ["security/detect-sql-injection"], _JS, "db.query('SELECT name FROM accounts WHERE key = ?', [key]);",
     [], "A parameterized query keeps data apart from SQL."),
    ("sql_injection_go", ["G201", "G202"], _GO, 'rows, err := db.Query("SELECT name FROM accounts WHERE key = $1", key)',
     [], "Pass values through placeholders of a parameterized query."),
    ("weak_crypto_go", ["G401", "G501"], _GO, "sum := sha256.Sum256(payload)",
     ["crypto/sha256"], "Take SHA-256 or stronger."),
    ("unsafe_code", ["clippy::unsafe_code"], _RS, "items.push(item); // a Vec instead of a raw pointer",
     [], "Safe containers do what the unsafe block did."),
]


def template_table(spark: SparkSession, templates: list = TEMPLATES) -> DataFrame:
    """Templates as rows; users append rows of their own with higher ``ord``."""
    rows = [(i, *t) for i, t in enumerate(templates)]
    ddl = (
        "ord int, vulnerability_type string, rule_ids array<string>, languages array<string>, template string, "
        "imports_needed array<string>, explanation string"
    )
    return local_table(spark, rows, ddl)


def templates_by_pair(templates: DataFrame) -> DataFrame:
    """The first template of each (rule, language) pair."""
    pairs = templates.withColumn("rule_id", F.explode("rule_ids")).withColumn("language", F.explode("languages"))
    chosen = F.min_by(
        F.struct("vulnerability_type", "template", "imports_needed", "explanation"), F.col("ord")
    )
    return pairs.groupBy("rule_id", "language").agg(chosen.alias("t")).select("rule_id", "language", "t.*")


def match_templates(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Findings with the columns of their template, null without one; language by file extension."""
    own = templates_by_pair(templates).select(
        "rule_id",
        F.col("language").alias("fix_language"),
        "vulnerability_type",
        "template",
        "imports_needed",
        F.col("explanation").alias("template_explanation"),
    )
    return findings.withColumn("fix_language", fix_language(F.col("file_path"))).join(
        own, ["rule_id", "fix_language"], "left"
    )


def templates_for_language(templates: DataFrame, language: str) -> DataFrame:
    return templates.where(F.array_contains("languages", language))


def supported_rules(templates: DataFrame) -> DataFrame:
    """Distinct rule ids per language."""
    pairs = templates.select(F.explode("languages").alias("language"), "rule_ids")
    return (
        pairs.select("language", F.explode("rule_ids").alias("rule_id"))
        .groupBy("language")
        .agg(F.sort_array(F.collect_set("rule_id")).alias("rule_ids"))
    )


def original_code(findings: DataFrame) -> Column:
    """Code to fix: the context if there is one, else the snippet."""
    if "context" in findings.columns:
        return F.coalesce("context.context_code", "code_snippet", F.lit(""))
    return F.coalesce("code_snippet", F.lit(""))


def fix_requests(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """Findings with ``original_code``, their template and the fix ``prompt``."""
    rows = match_templates(findings.withColumn("original_code", original_code(findings)), templates)
    return rows.withColumn("prompt", prompts.fix_prompt())


def suggestions(answered: DataFrame) -> DataFrame:
    """Fix suggestions from requests with their ``response`` text.

    With a template the answer is code only and explanation and imports are the template's;
    without one the answer holds code and explanation.
    """
    guided = F.col("vulnerability_type").isNotNull()
    code, explanation = prompts.split_fix_response(F.col("response"))
    fixed = F.when(guided, prompts.clean_code(prompts.strip(F.col("response")))).otherwise(code)
    rows = answered.where("response IS NOT NULL").withColumn("fixed_code", fixed)
    return rows.select(
        F.col("id").alias("finding_id"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("line_number", F.lit(0)).alias("line_number"),
        "original_code",
        "fixed_code",
        F.when(guided, F.col("template_explanation")).otherwise(explanation).alias("explanation"),
        F.when(guided, TEMPLATE_CONFIDENCE).otherwise(FREE_CONFIDENCE).alias("confidence"),
        F.coalesce("imports_needed", F.array().cast("array<string>")).alias("imports_needed"),
        F.col("vulnerability_type").alias("template_used"),
    )


def is_real_fix(original: Column, fixed: Column) -> Column:
    """Not blank, and different from the original apart from outer white space."""
    cleaned = prompts.strip(F.coalesce(fixed, F.lit("")))
    return (cleaned != "") & (cleaned != prompts.strip(F.coalesce(original, F.lit(""))))


def acceptance(confidence: Column) -> Column:
    """accept from 0.8, review below 0.7, consider between."""
    return (
        F.when(confidence >= ACCEPTED_CONFIDENCE, "accept")
        .when(confidence < REVIEW_CONFIDENCE, "review")
        .otherwise("consider")
    )


# Messages of checks that are not made.
_TOOL_MISSING = {
    "javascript": "Validation skipped (Node.js not available)",
    "typescript": "Validation skipped (TypeScript not available)",
    "go": "Validation skipped (Go not available)",
    "rust": "Validation skipped (Rust not available)",
}
_QUOTED = r"""(?s)\"{3}.*?\"{3}|'{3}.*?'{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*"""


def open_brackets(code: Column) -> Column:
    """Brackets of Python code that nothing closes, in order; a closing one without its partner stays too.

    Strings and comments are taken out first; the rest is a fold over the brackets alone.
    """
    found = F.regexp_extract_all(F.regexp_replace(code, _QUOTED, ""), F.lit(r"[()\[\]{}]"), F.lit(0))
    partner = lambda b: F.translate(b, ")]}", "([{")

    def step(left: Column, b: Column) -> Column:
        closes = b.isin(")", "]", "}") & (F.right(left, F.lit(1)) == partner(b))
        return F.when(closes, F.substring(left, F.lit(1), F.length(left) - 1)).otherwise(F.concat(left, b))

    return F.aggregate(found, F.lit(""), step)


def syntax_check(code: Column, language: Column) -> Column:
    """``struct<ok, message>``: brackets of Python are matched; other languages are skipped as valid."""
    known = F.lower(language)
    skipped = F.concat(F.lit("Validation skipped (unsupported language: "), language, F.lit(")"))
    for name, text in _TOOL_MISSING.items():
        skipped = F.when(known == name, F.lit(text)).otherwise(skipped)
    left = open_brackets(F.coalesce(code, F.lit("")))
    python = F.when(left == "", "").otherwise(F.concat(F.lit("Unmatched brackets: "), left))
    is_python = F.coalesce(known == "python", F.lit(False))
    return F.struct((~is_python | (left == "")).alias("ok"), F.when(is_python, python).otherwise(skipped).alias("message"))


def _rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising subsequence of distinct numbers."""
    ends, last, before = [], [], []
    for k, p in enumerate(places):
        at = bisect_left(ends, p)
        before.append(last[at - 1] if at else -1)
        ends[at:at + 1], last[at:at + 1] = [p], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def changed_lines(old: Sequence[str], new: Sequence[str]) -> tuple[list[int], list[int]]:
    """Indexes of the lines only one side has.

    Lines that occur once on each side of a stretch are its anchors, as many as rise
    together; the stretches between anchors are treated likewise, after what they begin and end with in common.
    """
    removed, added, todo = [], [], [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
        once = Counter(old[a:b]), Counter(new[c:d])
        place = {new[j]: j for j in range(c, d) if once[1][new[j]] == 1}
        shared = [(i, place[old[i]]) for i in range(a, b) if once[0][old[i]] == 1 and old[i] in place]
        if not shared:
            removed += range(a, b)
            added += range(c, d)
            continue
        kept = [shared[k] for k in _rising([j for _, j in shared])]
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(removed), sorted(added)


_PLACES = T.ArrayType(T.IntegerType())


@F.pandas_udf(T.StructType([T.StructField("removed", _PLACES), T.StructField("added", _PLACES)]))
def _changed(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    found = [([], []) if a is None or b is None else changed_lines(a.split("\n"), b.split("\n")) for a, b in zip(old, new)]
    return pd.DataFrame(found, columns=["removed", "added"])


def line_changes(fixes: DataFrame, key: str = "finding_id") -> DataFrame:
    """``key, op, line_number, line``: the lines a fix removes (-) and adds (+), numbered in their own text.

    What both texts begin or end with is kept; in between, lines that are unique in both
    anchor the comparison (:func:`changed_lines`), so edits far apart are hunks of their own and, where all lines
    are unique, the fewest lines change. Found inside the row: no line is shuffled.
    """
    rows = fixes.select(
        key, "original_code", "fixed_code", F.split("original_code", "\n", -1).alias("old"), F.split("fixed_code", "\n", -1).alias("new")
    ).withColumn("c", _changed("original_code", "fixed_code"))

    def hunk(side: str, op: str, changed: str) -> Column:
        return F.transform(changed, lambda i: F.struct(F.lit(op).alias("op"), (i + 1).alias("line_number"), F.get(side, i).alias("line")))

    changes = F.concat(hunk("old", "-", "c.removed"), hunk("new", "+", "c.added"))
    return rows.select(key, F.explode(changes).alias("c")).select(key, "c.*")


def apply_fixes(files: DataFrame, fixes: DataFrame, by: Sequence[str] = ("file_path",)) -> DataFrame:
    """Files ``(file_path, content)`` after their fixes in ``ord``: new content, old one as backup.

    Each fix replaces every occurrence of its original code in what the fixes before it
    left, so the fixes of one file form a sequence by nature; files are independent. Blank
    originals are refused. ``by`` names a file; with several repositories it holds their key too.
    """
    own = (
        fixes.where(prompts.strip(F.col("original_code")) != "")
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "original_code", "fixed_code"))).alias("steps"))
    )
    changed = F.aggregate(
        "steps", F.col("content"), lambda text, s: F.replace(text, s["original_code"], s["fixed_code"])
    )
    return files.join(own, [*by]).select(
        *by, changed.alias("content"), F.col("content").alias("backup"), F.size("steps").alias("fixes")
    )


def write_fixed_files(applied: DataFrame, path: str, dry_run: bool = True) -> bool:
    """Write the changed files and their backups as a new snapshot; a dry run writes nothing."""
    if not dry_run:
        applied.write.mode("overwrite").parquet(path)
    return True
