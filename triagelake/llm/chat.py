"""Conversations as training text: a finite-state machine over roles, driven by a declarative template.

The template lists, per role, the segments a turn is written as and which of them carry loss, and
the machine's transitions say which role may follow which. Each turn moves the
machine one step and emits its segments; a turn the machine has no move for sends it to a state it
never leaves, so a conversation is valid if its last state accepts. Texts may hold the template's marks: they
are escaped, and :func:`read_back` recovers every turn from the formatted text alone.

Turns are sorted inside bounded parts and streamed. A long conversation is cut into parts of equal depth;
what a part does to the machine is a function from state to state, and
chaining those functions gives every part the state it starts in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators.ordered import equal_depth

#: Turns of a part, about; a conversation of fewer turns is one part.
PART_TURNS = 4096

ROLE, TEXT = "{role}", "{text}"
#: The state of a conversation that broke the order.
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """How a turn is written, and the order of roles.

    ``segments`` are literal strings, ``ROLE`` or ``TEXT``, each with the roles under whose turns it carries loss.
    The first segment opens a turn, the one after ``ROLE`` ends the role, the last closes the turn;
    opening and closing marks begin with ``<|``. ``moves`` maps (state, role) to the next state.
    """

    segments: tuple[tuple[str, frozenset[str]], ...]
    moves: dict[tuple[str, str], str] = field(hash=False)
    start: str = "start"
    accepting: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        kinds = [s for s, _ in self.segments]
        if len(kinds) != 5 or kinds[1] != ROLE or kinds[3] != TEXT or not (kinds[0].startswith("<|") and kinds[4].startswith("<|")) or kinds[2] != "\n":
            raise ValueError("a turn is: mark, role, line end, text, mark; marks begin with <|")

    @cached_property
    def states(self) -> list[str]:
        return [self.start, BROKEN, *sorted({s for s, _ in self.moves} | set(self.moves.values()) - {self.start, BROKEN})]

    def step(self, state: str, role: str) -> str:
        return self.moves.get((state, role), BROKEN)


#: Turns between <|im_start|> and <|im_end|>; only what the assistant says carries loss.
CHATML = Template(
    segments=(("<|im_start|>", frozenset()), (ROLE, frozenset()), ("\n", frozenset()), (TEXT, frozenset({"assistant"})), ("<|im_end|>\n", frozenset())),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
)

_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_NAME = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_NAMED = {v[1]: k for k, v in _NAME.items()}


def escape(text: str) -> str:
    """One more backslash between every ``<`` and ``|`` that are parted by backslashes alone, so that no ``<|`` is left."""
    return _MARK.sub(r"<\\\1|", text) if "|" in text and "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text and "<" in text else text


def write_role(role: str) -> str:
    """A role on one line and without ``<``."""
    return re.sub(r"[\\\n<]", lambda m: _NAME[m[0]], role)


def read_role(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: _NAMED[m[1]], name)


def write_turn(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """The segments of a turn and whether each carries loss."""
    filled = {ROLE: write_role(role), TEXT: escape(text)}
    return [(filled.get(kind, kind), role in trained) for kind, trained in template.segments]


def read_turns(template: Template, text: str) -> Iterator[tuple[str, str]]:
    """``role, text`` of every turn of a formatted text."""
    (opening, _), *_, (closing, _) = template.segments
    for turn in text.split(closing)[:-1]:
        if not turn.startswith(opening):
            raise ValueError("a turn does not begin with its mark")
        role, _, body = turn[len(opening) :].partition("\n")
        yield read_role(role), unescape(body)


@dataclass
class _Part:
    """A part being written: its formatted text so far, and the spans of it that carry loss."""

    key: tuple
    state: str
    position: int
    bad: int | None
    text: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[dict] = field(default_factory=list)

    def add(self, template: Template, role: str, text: str) -> None:
        after = template.step(self.state, role)
        if after == BROKEN and self.bad is None:
            self.bad = self.position
        self.state, self.position = after, self.position + 1
        for segment, loss in write_turn(template, role, text):
            if loss:
                self.spans.append({"start": self.size, "end": self.size + len(segment)})
            self.text.append(segment)
            self.size += len(segment)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FORMATTED = "conv_id long, part int, text string, loss array<struct<start: long, end: long>>, turns long, state string, bad_turn long"
_FIELDS = [("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", _SPANS), ("turns", pa.int64()), ("state", pa.string()), ("bad_turn", pa.int64())]
#: Characters written at a time.
FLUSH = 4 << 20


def _table(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _formatted(batches, template: Template):
    """Sorted turns ``conv_id, part, role, text, state, position, bad_turn`` as one row a part."""
    done, size, now = [], 0, None

    def close(p: _Part) -> tuple:
        return (*p.key, "".join(p.text), p.spans, p.position, p.state, p.bad)

    for b in batches:
        columns = [b.column(k).to_pylist() for k in ("conv_id", "part", "role", "text", "state", "position", "bad_turn")]
        for conv, part, role, text, state, position, bad in zip(*columns):
            if now is None or now.key != (conv, part):
                if now is not None:
                    done.append(close(now))
                    size += now.size
                    if size > FLUSH:
                        yield _table(done, _FIELDS)
                        done, size = [], 0
                now = _Part((conv, part), state, position, bad)
            now.add(template, role, text)
    if now is not None:
        done.append(close(now))
    yield _table(done, _FIELDS)


def _walked(batches, template: Template):
    """Sorted turns ``conv_id, part, role`` as one row a part: from each state, the state and the turn it broke at, if it did."""
    names = template.states
    now, runs, n, rows = None, {}, 0, []
    schema = [("conv_id", pa.int64()), ("part", pa.int32()), ("turns", pa.int64()), ("after", pa.list_(pa.string())), ("broke", pa.list_(pa.int64()))]

    def close():
        return (*now, n, [runs[s][0] for s in names], [runs[s][1] for s in names])

    for b in batches:
        for conv, part, role in zip(*[b.column(k).to_pylist() for k in ("conv_id", "part", "role")]):
            if now != (conv, part):
                if now is not None:
                    rows.append(close())
                now, runs, n = (conv, part), {s: (s, None) for s in names}, 0
            for s, (at, broke) in runs.items():
                after = template.step(at, role)
                runs[s] = (after, n if broke is None and after == BROKEN and at != BROKEN else broke)
            n += 1
    if now is not None:
        rows.append(close())
    yield _table(rows, schema)


def _chained(batches, template: Template):
    """Sorted parts of :func:`_walked` with the state, turn number and broken turn each starts with."""
    place = {s: i for i, s in enumerate(template.states)}
    conv, state, position, bad, first = None, template.start, 0, None, True
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if first or r["conv_id"] != conv:
                conv, state, position, bad, first = r["conv_id"], template.start, 0, None, False
            rows.append((conv, r["part"], state, position, bad))
            broke = r["broke"][place[state]]
            bad = position + broke if bad is None and broke is not None else bad
            state, position = r["after"][place[state]], position + r["turns"]
        yield _table(rows, [("conv_id", pa.int64()), ("part", pa.int32()), ("state", pa.string()), ("position", pa.int64()), ("bad_turn", pa.int64())])


_ORDER = ["conv_id", "part", "turn", "role", "text"]


def turns_of(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, turn, role, text, part``; null roles and texts are empty, null turns come first, equal turns are ordered by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return equal_depth(rows, ["conv_id"], F.col("turn"), "part", part_turns)


def format_turns(turns: DataFrame, template: Template = CHATML, several: bool = True) -> DataFrame:
    """:func:`turns_of` formatted; ``several`` is false if every conversation is known to be one part."""
    start = [F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("position"), F.lit(None).cast("long").alias("bad_turn")]
    if not several:
        rows = turns.select("*", *start).repartition("conv_id")
    else:
        walked = turns.drop("text").repartition("conv_id", "part").sortWithinPartitions(*_ORDER[:4])
        walked = walked.select("conv_id", "part", "role").mapInArrow(partial(_walked, template=template), "conv_id long, part int, turns long, after array<string>, broke array<long>")
        chained = walked.repartition("conv_id").sortWithinPartitions("conv_id", "part")
        starts = chained.mapInArrow(partial(_chained, template=template), "conv_id long, part int, state string, position long, bad_turn long")
        key = F.struct("conv_id", "part")
        rows = turns.withColumn("of", key).join(starts.select(key.alias("of"), "state", "position", "bad_turn"), "of").drop("of").repartition("conv_id", "part")
    rows = rows.sortWithinPartitions(*_ORDER)
    return rows.select("conv_id", "part", "role", "text", "state", "position", "bad_turn").mapInArrow(partial(_formatted, template=template), _FORMATTED)


def format_conversations(conversations: DataFrame, template: Template = CHATML, part_turns: int = PART_TURNS) -> DataFrame:
    """A row per conversation, or per part of some ``part_turns`` turns of a longer one, in order of ``part``.

    ``text`` is the formatted text, ``loss`` the spans of it (in characters) that carry loss, ``turns`` and ``state`` the
    number of turns and the machine's state after the part, ``bad_turn`` the first turn (from 0) it had no move for, null if none:
    a conversation is valid if its last state accepts. Invalid conversations are formatted all the same. Null
    ids are one conversation, repeated rows are turns of their own, other columns are not read, an empty table gives none. The parts
    of a conversation together are its text; memory is bounded by a part.
    """
    whole, cut = by_length(turns_of(conversations, part_turns))
    return format_turns(whole, template, False).unionByName(format_turns(cut, template))


def by_length(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations of one part, and of the longer ones."""
    key = F.struct("conv_id")
    several = turns.filter("part > 0").select(key.alias("of")).distinct()
    tagged = turns.withColumn("of", key)
    return tagged.join(several, "of", "left_anti").drop("of"), tagged.join(several, "of", "left_semi").drop("of")


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn long"
_READ_FIELDS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("bad_turn", pa.int64())]


def _digested(batches, template: Template):
    """Sorted parts as one row a conversation; only hash states are carried from part to part."""
    now, rows = None, []

    def fresh():
        return {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "state": None, "bad": None}

    def close():
        key, s = now
        return (key, s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["state"] in template.accepting, s["bad"])

    for b in batches:
        # Text of one part at a time.
        for k in range(b.num_rows):
            conv, _, text, loss, _, state, bad = (b.column(c)[k].as_py() for c in range(7))
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(close())
                    if len(rows) >= 4096:
                        yield _table(rows, _READ_FIELDS)
                        rows = []
                now = (conv, fresh())
            s = now[1]
            for role, body in read_turns(template, text):
                s["turns"] += 1
                s["all"].update(f"{role}\n{body}\n".encode())
            for span in loss:
                body = unescape(text[span["start"] : span["end"]])
                s["chars"] += len(body)
                s["loss"].update(body.encode())
            s["size"] += len(text)
            s["state"], s["bad"] = state, bad
    if now is not None:
        rows.append(close())
    yield _table(rows, _READ_FIELDS)


def read_back(formatted: DataFrame, template: Template = CHATML, several: bool = True) -> DataFrame:
    """Per conversation what its formatted text and loss spans say: turns and their digest, loss text and its digest, length, validity.

    A digest over a conversation is sequential by its definition, so the parts of one conversation are
    streamed through one task (with one part in memory); conversations of one part (``several`` false) are read where they lie.
    """
    if several:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(partial(_digested, template=template), _READ)


def digests(conversations: DataFrame, template: Template = CHATML, part_turns: int = PART_TURNS) -> DataFrame:
    """:func:`read_back` of :func:`format_conversations`; conversations of one part are shuffled once."""
    whole, cut = by_length(turns_of(conversations, part_turns))
    one = read_back(format_turns(whole, template, False), template, False)
    return one.unionByName(read_back(format_turns(cut, template), template))
