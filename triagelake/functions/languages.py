"""Languages by file extension, and file filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.severity import lookup
from triagelake.schemas import DEFAULT_SCAN_LANGUAGES

# Three maps for three uses.
SCANNER_EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "cpp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
}
CONTEXT_EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
}
# .jsx and .tsx are added to the fix map so that React files find their templates.
FIX_EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".php": "php",
}
IGNORED_DIRECTORIES = [".git", "node_modules", "__pycache__", ".venv", "venv"]


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; '' for none or for a dot-file."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def scanner_language(path: Column) -> Column:
    return lookup(extension(path), SCANNER_EXTENSIONS, None)


def context_language(path: Column) -> Column:
    return lookup(extension(path), CONTEXT_EXTENSIONS, None)


def fix_language(path: Column) -> Column:
    return lookup(extension(path), FIX_EXTENSIONS, "unknown")


def with_extensions(path: Column, extensions: list[str]) -> Column:
    """True for paths ending in any of the extensions."""
    return reduce(lambda a, b: a | b, [path.endswith(e) for e in extensions])


def language_extensions(language: str) -> list[str]:
    return [e for e, name in CONTEXT_EXTENSIONS.items() if name == language.lower()]


def outside_ignored(path: Column) -> Column:
    """True unless a directory of the path is an ignored one (whole names, so .github stays)."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))


def select_languages(findings: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Findings of the chosen languages; an unsupported name is an error."""
    chosen = [name.lower() for name in (languages or DEFAULT_SCAN_LANGUAGES)]
    unknown = sorted(set(chosen) - set(SCANNER_EXTENSIONS.values()))
    if unknown:
        raise ValueError(f"unsupported language: {', '.join(unknown)}")
    return findings.where(F.col("language").isin(chosen))
