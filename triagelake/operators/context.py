"""Source context of findings: line windows, enclosing functions and classes, imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.symbols import enclosing_symbols, symbol_spans

CONTEXT_LINES = 10
MAX_IMPORTS = 10
BLOCK = 64
#: What names a file where all rows are of one repository.
PATH = ("file_path",)

# What an import statement looks like.
IMPORT_PATTERN = {
    "python": r"^(import\s+\S|from\s+\S+\s+import\b)",
    "javascript": r"^import\b",
}


def _lines(content: str = "content") -> Column:
    return F.split(content, "\n", -1)


def line_blocks(
    files: DataFrame, context_lines: int = CONTEXT_LINES, block: int = BLOCK, by: Sequence[str] = PATH
) -> DataFrame:
    """Files cut into blocks of lines that overlap by the context on both sides.

    Every finding's window lies inside exactly one block, so findings meet their source in
    one equality join on (file, block): no range join, no regrouping of lines, and only
    about 1.3 times the text is moved, in pieces of bounded size.
    """
    size = max(block, 2 * context_lines)

    def piece(b: Column) -> Column:
        first = F.greatest(F.lit(1), b * size + 1 - context_lines)
        return F.struct(
            b.alias("block"),
            first.alias("first_line"),
            F.slice("lines", first, (b + 1) * size + context_lines - first + 1).alias("text"),
        )

    return (
        files.select(*by, _lines().alias("lines"))
        .select(*by, F.explode(F.transform(F.sequence(F.lit(0), _last_block(F.size("lines"), size, context_lines)), piece)).alias("p"))
        .select(*by, "p.*")
    )


def _last_block(n_lines: Column, size: int, context_lines: int) -> Column:
    """Number of a file's last block, which reaches ``context_lines`` past the end."""
    return F.floor((n_lines + context_lines - 1) / size).cast("int")


def line_context(
    findings: DataFrame,
    files: DataFrame,
    context_lines: int = CONTEXT_LINES,
    block: int = BLOCK,
    by: Sequence[str] = PATH,
) -> DataFrame:
    """Findings with the ± ``context_lines`` window around their line, clipped to the file.

    ``by`` names a file in both tables; where several repositories, commits or jobs are in
    one table, their key belongs to it. Adds ``context_start_line``, ``context_end_line``
    and ``context_code``; they are null where the file or the line number is unknown. A line
    before the first counts from there; the window of a line far past the end is empty.
    """
    size = max(block, 2 * context_lines)
    lengths = files.select(*by, F.size(_lines()).alias("n_lines"))
    located = findings.join(lengths, [*by], "left")
    wanted = F.floor((F.col("line_number") - 1) / size).cast("int")
    last = _last_block(F.col("n_lines"), size, context_lines)
    # greatest and least skip nulls, an unknown line or file stays null.
    inside = F.when(F.col("line_number").isNotNull() & F.col("n_lines").isNotNull(), F.least(F.greatest(wanted, F.lit(0)), last))
    joined = located.withColumn("block", inside).join(line_blocks(files, context_lines, block, by), [*by, "block"], "left")
    start = F.greatest(F.lit(1), F.col("line_number") - context_lines)
    end = F.least(F.col("n_lines"), F.col("line_number") + context_lines)
    found = F.col("block").isNotNull()
    window = F.slice("text", F.greatest(start - F.col("first_line") + 1, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
    return joined.select(
        *findings.columns,
        F.when(found, F.array_join(window, "\n")).alias("context_code"),
        F.when(found, start).alias("context_start_line"),
        F.when(found, end).alias("context_end_line"),
    )


def _imports(lines: Column, language: Column, n: int = MAX_IMPORTS) -> Column:
    trimmed = F.transform(lines, lambda line: F.trim(line))

    def matching(kind: str) -> Column:
        return F.filter(trimmed, lambda line: F.rlike(line, F.lit(IMPORT_PATTERN[kind])))

    javascript = F.lower(language).isin("javascript", "typescript")
    return F.slice(F.when(javascript, matching("javascript")).otherwise(matching("python")), 1, n)


def file_imports(files: DataFrame, n: int = MAX_IMPORTS, by: Sequence[str] = PATH) -> DataFrame:
    """First ``n`` import statements per file named by ``by``, computed row by row without a shuffle."""
    return files.select(*by, _imports(_lines(), F.col("language"), n).alias("imports"))


def spans(files: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """One row per function or class of files named by ``by`` with ``content, language``."""
    return files.select(*by, F.explode(symbol_spans(F.col("content"), F.col("language"))).alias("s")).select(*by, "s.*")


def place_contexts(
    findings: DataFrame, files: DataFrame, context_lines: int = CONTEXT_LINES, by: Sequence[str] = PATH
) -> DataFrame:
    """One ``context`` per distinct ``line_number`` of a file named by ``by``.

    The distinct lines of a file are gathered first: a set no larger than the file's own
    lines, combined on the map side, so a file with most of the findings joins as one row
    like any other. Files without findings drop out in that join before they are parsed,
    and each remaining file is parsed once. Contexts are cut inside the file's row; only
    they are exploded, never the file with each of its lines.
    """
    places = findings.where("line_number IS NOT NULL").groupBy(*by).agg(F.collect_set("line_number").alias("places"))
    rows = (
        files.join(places, [*by])
        .withColumn("around", enclosing_symbols("content", "language", F.col("places").cast("array<int>")))
        .withColumn("lines", _lines())
        .withColumn("imports", _imports(F.col("lines"), F.col("language")))
    )

    def bounds(p: Column) -> Column:
        first, last = (F.coalesce(p[f"function_{end}"], p[f"class_{end}"]) for end in ("start", "end"))
        return F.struct(
            p["line"].alias("line"),
            p["function_start"].isNotNull().alias("in_function"),
            first.isNotNull().alias("in_span"),
            p["function_name"].alias("function_name"),
            p["class_name"].alias("class_name"),
            F.coalesce(first, F.greatest(F.lit(1), p["line"] - context_lines)).alias("first"),
            F.coalesce(last, F.least(F.size("lines"), p["line"] + context_lines)).alias("last"),
        )

    def context(p: Column) -> Column:
        text = F.array_join(F.slice("lines", p["first"], F.greatest(p["last"] - p["first"] + 1, F.lit(0))), "\n")
        return F.struct(
            F.col("file_path").alias("file"),
            p["line"].alias("target_line"),
            p["first"].alias("context_start_line"),
            p["last"].alias("context_end_line"),
            F.when(p["in_span"], F.ltrim(text)).otherwise(text).alias("context_code"),
            F.when(p["in_function"], "function")
            .when(p["in_span"], "class")
            .otherwise("line_based_fallback")
            .alias("context_type"),
            p["function_name"].alias("function_name"),
            p["class_name"].alias("class_name"),
            F.col("imports").alias("imports"),
        )

    cut = F.transform(F.transform("around", bounds), context)
    return rows.select(*by, F.explode(cut).alias("context")).select(
        *by, F.col("context.target_line").alias("line_number"), "context"
    )


def attach_context(
    findings: DataFrame, files: DataFrame, context_lines: int = CONTEXT_LINES, by: Sequence[str] = PATH
) -> DataFrame:
    """Findings with a ``context`` struct; null where the file or line is unknown.

    The innermost function around the line, else the innermost class, else the line
    window; ``files`` is ``by`` with ``content, language``.
    """
    contexts = place_contexts(findings, files, context_lines, by)
    return findings.join(contexts, [*by, "line_number"], "left").select(*findings.columns, "context")
