"""Functions and classes of source texts, found by their heads and by bracket depth or indentation.

Strings and comments are blanked first, so that nothing inside them opens or ends a symbol.
Each text is read once from start to end; symbols and brackets that are open lie on a stack, and each
is taken off once, so the cost is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
        ]
    )
)

_PLAIN = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
#: Strings and comments by language; a comment begins with # or /.
_BLANKED = {
    "python": re.compile(rf"(?s)\"{{3}}.*?(?:\"{{3}}|\Z)|'{{3}}.*?(?:'{{3}}|\Z)|{_PLAIN}|#[^\n]*"),
    "javascript": re.compile(rf"(?s)/\*.*?(?:\*/|\Z)|//[^\n]*|`(?:\\.|[^`\\])*`?|{_PLAIN}"),
}
#: Stands for what is inside a string.
_INSIDE = "\x01"

_PY_HEAD = re.compile(r"[ \t]*(?:(class)|(?:async\s+)?def)\s+(\w+)")
_JS_HEAD = re.compile(
    r"(?m)^[ \t]*(?:(?:export|default|async|static|get|set)\s+)*(?:(class)\s+(?!extends\b)([\w$]+)"
    r"|function\b\s*\*?\s*([\w$]*)\s*(?=\()"
    r"|(?:const|let|var)\s+[\w$]+\s*=\s*(?:async\s+)?(?:function\b|(?=(?:\([^()]*\)|[\w$]+)\s*=>\s*\{))"
    r"|(?!(?:if|for|while|switch|catch|with|return|function)\b)([\w$]+)\s*(?=\())"
)

_JS_BODY = re.compile(r"\s*\{")


def _blank(text: str, language: str) -> str:
    """The text with strings and comments blanked, every character in its place."""

    def blanked(m: re.Match) -> str:
        if m[0][0] in "#/":
            return re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + re.sub(r"[^\n]", _INSIDE, m[0][1:])

    return _BLANKED[language].sub(blanked, text)


def python_spans(text: str) -> list[tuple[str, str, int, int]]:
    """Symbols reach to the last line of code before one that is indented no deeper; lines inside brackets, strings or after a backslash go on."""
    open_, out, last, depth, joined = [], [], 0, 0, False

    def close(indent: int) -> None:
        while open_ and open_[-1][3] >= indent:
            kind, name, start, _ = open_.pop()
            out.append((kind, name, start, last))

    for no, line in enumerate(re.split("\r?\n", _blank(text, "python")), 1):
        code = line.strip()
        if not code:
            continue
        if not (depth or joined or line.startswith(_INSIDE)):
            indent = len(line) - len(line.lstrip(" \t"))
            close(indent)
            head = _PY_HEAD.match(line)
            if head:
                open_.append(("class" if head[1] else "function", head[2], no, indent))
        last, joined = no, code.endswith("\\")
        depth = max(0, depth + sum(map(code.count, "([{")) - sum(map(code.count, ")]}")))
    close(0)
    return sorted(out, key=lambda s: s[2])


def javascript_spans(text: str) -> list[tuple[str, str | None, int, int]]:
    """Symbols reach to the bracket that closes their body, whatever the indentation; a head without a body is its own line."""
    code = _blank(text, "javascript")
    marks = [(m.start(), m[0]) for m in re.finditer(r"[(){};]", code)]
    places = [at for at, _ in marks]
    closing, open_ = {}, {"}": [], ")": []}
    for at, mark in marks:
        if mark in "({":
            open_[")" if mark == "(" else "}"].append(at)
        elif mark != ";" and open_[mark]:
            closing[open_[mark].pop()] = at
    ends = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(ends, at - 1) + 1
    last = line(len(code.rstrip()) - 1) if code.strip() else 1
    out = []
    for head in _JS_HEAD.finditer(code):
        begin = head.start() + len(head[0]) - len(head[0].lstrip())
        depth, body = 0, None
        if head[4] and not _JS_BODY.match(code, closing.get(head.end(), len(code)) + 1):
            continue  # a call, not a method
        # From the head over its parameters to the bracket that opens its body.
        for k in range(bisect_right(places, head.end() - 1), len(marks)):
            at, mark = marks[k]
            depth = max(0, depth + {"(": 1, ")": -1}.get(mark, 0))
            if depth == 0 and mark in "{};":
                body = at if mark == "{" else None
                break
        start = line(begin)
        end = start if body is None else line(closing[body]) if body in closing else last
        out.append(("class" if head[1] else "function", head[2] or head[3] or head[4] or None, start, end))
    return out


_READERS = {"python": python_spans, "javascript": javascript_spans}


@F.pandas_udf(_SPANS)
def _spans(code: pd.Series, language: pd.Series) -> pd.Series:
    names = [f.name for f in _SPANS.elementType]
    found = ([] if text is None else _READERS[name](text) for text, name in zip(code, language))
    return pd.Series([[dict(zip(names, s)) for s in own] for own in found], dtype=object)


def symbol_spans(code: Column, language: Column) -> Column:
    """``array<struct<kind, name, start_line, end_line>>`` of the functions and classes of a text, by their first lines.

    Python goes by indentation, JavaScript by brackets (regular expressions in slashes are not
    told from divisions, so quotes and brackets in them count). Other languages and null have none.
    """
    name = F.lower(language)
    known = F.coalesce(name.isin(list(_READERS)), F.lit(False))
    return F.when(known, _spans(F.when(known, code), F.when(known, name))).otherwise(F.array().cast(_SPANS))


def innermost(spans: list[tuple], lines: list[int]) -> list[tuple]:
    """``line`` and, for the smallest function and the smallest class around it, name, start and end; of equal ones the later."""
    waiting, around, out = sorted(spans, key=lambda s: s[2], reverse=True), [], []
    for line in sorted(lines):
        while waiting and waiting[-1][2] <= line:
            around.append(waiting.pop())
        around = [s for s in around if s[3] >= line]
        row = (line,)
        for kind in ("function", "class"):
            best = min((s for s in around if s[0] == kind), key=lambda s: (s[3] - s[2], -s[2]), default=(None,) * 4)
            row += best[1:]
        out.append(row)
    return out


_AROUND = T.ArrayType(
    T.StructType(
        [T.StructField("line", T.IntegerType())]
        + [
            T.StructField(f"{kind}_{part}", T.StringType() if part == "name" else T.IntegerType())
            for kind in ("function", "class")
            for part in ("name", "start", "end")
        ]
    )
)


@F.pandas_udf(_AROUND)
def enclosing_symbols(code: pd.Series, language: pd.Series, lines: pd.Series) -> pd.Series:
    """For each of ``lines`` the innermost function and class of the text around it (:func:`innermost`)."""
    names = [f.name for f in _AROUND.elementType]
    out = []
    for text, name, own in zip(code, language, lines):
        reader = _READERS.get((name or "").lower())
        found = innermost(reader(text) if reader and text is not None else [], own.tolist())
        out.append([dict(zip(names, row)) for row in found])
    return pd.Series(out, dtype=object)
