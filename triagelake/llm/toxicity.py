"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the tags of a clause one after the other, each rewriting what the one before
wrote: insults and threats mark words, the target transducer joins them with whom they are
said to, negation and reported speech weaken what follows. Their composition yields the
matches of a clause with a path (targeted, negated, reported), and a text's score is the
chance that at least one match is meant. Insults and the weight of every path are learned from labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of the grammar in English, German, French and Spanish.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting dummkopf trottel abschaum imbécile crétin ordure estúpido basura escoria".split()
THREATS = "kill hurt destroy töten umbringen vernichten tuer frapper détruire matar herir destruir".split()
TARGETS = "you your yours he him his she her they them their du dich dir ihr euch sie er tu te toi vous il elle ils elles tú ti usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie pas jamais non nunca jamás ni".split()
REPORTS = "said says say wrote writes called quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()

_CLAUSE = re.compile(r"[.!?;\n\r]")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"«»“”„]")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTES = set('"«»“”„')

#: Labelled rows the grammar is fitted on at most (those of the smallest hash).
MAX_ROWS = 24_000
#: Lengths of the word beginnings that may enter the lexicon beside whole words.
STEMS = range(4, 8)
#: How much a weight starts as it is in matches of this number.
PRIOR = 4.0
PATHS = {"plain": 0.9, "targeted": 0.95, "negated": 0.4, "reported": 0.4, "threat": 0.8}


@dataclass
class Transducer:
    """``arcs[state][tag] = (next state, tag written)``; a tag without an arc is copied and leads to ``rest[state]``."""

    arcs: dict[int, dict[str, tuple[int, str]]]
    rest: dict[int, int] = field(default_factory=dict)

    def run(self, tags: list[str]) -> list[str]:
        state, out = 0, []
        for tag in tags:
            state, wrote = self.arcs.get(state, {}).get(tag, (self.rest.get(state, state), tag))
            out.append(wrote)
        return out


def _window(start: str, mark: dict[str, str], reach: int) -> Transducer:
    """After ``start``, rewrites the tags of ``mark`` for ``reach`` more tokens."""
    begin = {start: (1, start)}
    arcs: dict[int, dict[str, tuple[int, str]]] = {0: begin}
    rest = {0: 0}
    for k in range(1, reach + 1):
        arcs[k] = begin | {tag: (k, new) for tag, new in mark.items()}
        rest[k] = k + 1 if k < reach else 0
    return Transducer(arcs, rest)


_THREAT = _window("hit", {"target": "threat"}, 2)
_AIM_AFTER = _window("target", {"insult": "targeted"}, 5)
_NEGATE = _window("not", {"insult": "negated", "targeted": "negated", "threat": "negated"}, 3)
_REPORT = Transducer({0: {"says": (1, "says")}, 1: {t: (1, "reported") for t in ("insult", "targeted", "threat")}}, {0: 0, 1: 1})
_MEANT = ("insult", "targeted", "negated", "reported", "threat")
_NAMES = {"insult": "plain"}


def compose(tags: list[str]) -> list[str]:
    """The composition insult > threat > target > negation > reported speech over the tags of a clause."""
    tags = _AIM_AFTER.run(_THREAT.run(tags))
    # A target may also follow: the same transducer reads the clause backwards.
    tags = _AIM_AFTER.run(tags[::-1])[::-1]
    return _REPORT.run(_NEGATE.run(tags))


@dataclass
class Grammar:
    """Weights of insults (``word`` or ``stem*``) and of paths, and the score of a text without a match."""

    insults: dict[str, float]
    paths: dict[str, float]
    base: float = 0.05

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.words = {w: p for w, p in grammar.insults.items() if not w.endswith("*")}
        self.stems = {w[:-1]: p for w, p in grammar.insults.items() if w.endswith("*")}
        self.plain = {}
        for tag, words in (("hit", THREATS), ("target", TARGETS), ("not", NEGATIONS), ("says", REPORTS)):
            self.plain |= dict.fromkeys(words, tag)
        self.find = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def matches(self, text: str) -> list[tuple[int, int, str, float]]:
        """``start, end, path, probability`` of every match, in order."""
        low = text.lower()
        out, done = [], -1
        for last, size in self.find.iter(low):
            at = last - size + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            begin = max((low.rfind(c, max(done, 0), at) for c in ".!?;\n\r"), default=-1) + 1
            begin = max(begin, done, 0)
            found = _CLAUSE.search(low, last)
            done = found.start() if found else len(low)
            tokens = list(_TOKEN.finditer(low, begin, done))
            tags, weights = [], []
            for t in tokens:
                word = t.group()
                w = self.weight(word)
                weights.append(w)
                tags.append("insult" if w else "says" if word in _QUOTES else self.plain.get(word, "word"))
            for t, tag, w in zip(tokens, compose(tags), weights):
                if tag in _MEANT:
                    path = _NAMES.get(tag, tag)
                    out.append((t.start(), t.end(), path, (w or 1.0) * self.grammar.paths[path]))
        return out

    def score(self, text: str | None) -> float:
        found = self.matches(text) if text else []
        if not found:
            return self.grammar.base
        rest = 1.0 - self.grammar.base
        for *_, p in found:
            rest *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - rest))


def _features(text: str) -> set[str]:
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)}


def _count_features(batches):
    """text, toxic -> feature with its number of toxic and clean texts."""
    for b in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            counts[toxic].update(_features(text or ""))
        names = list(counts[1])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()), pa.array([0] * len(names), pa.int64())], names=["feature", "toxic", "clean"])
        names = list(counts[0])
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([counts[0][w] for w in names], pa.int64())], names=["feature", "toxic", "clean"])


def _paths_of(batches, grammar: Grammar):
    """text, toxic -> path with whether the text is toxic, once for a text; "none" without a match."""
    compiled = grammar.compiled()
    for b in batches:
        rows = [(p, t) for text, t in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()) for p in {m[2] for m in compiled.matches(text or "")} or {"none"}]
        yield pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.int32())], names=["path", "toxic"])


def _cover(lists: list[list[int]], toxic: np.ndarray, clean: np.ndarray, length: np.ndarray, least: int) -> list[int]:
    """Features that together cover the toxic texts, each adding ``least`` texts or more; the longest of equals."""
    chosen, open_texts = [], [set(x) for x in lists]
    while True:
        gain = Counter(f for s in open_texts for f in s)
        if not gain:
            return chosen
        best = max(gain, key=lambda f: (gain[f] - 3 * clean[f], length[f], -f))
        if gain[best] - 3 * clean[best] < least:
            return chosen
        chosen.append(best)
        open_texts = [s for s in open_texts if best not in s]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Grammar:
    """Fit lexicon and path weights on at most ``max_rows`` labelled rows (0 or 1 in ``labels.toxic``).

    Candidates are words and stems at least nine tenths of whose texts are toxic; the lexicon is
    the smallest-first cover of the toxic texts by them, so rare words that merely stand
    beside an insult do not enter. The fixed words keep a prior weight.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(_count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    listed = counted.filter("toxic >= 3 and toxic >= 9 * clean").collect()
    index = {r.feature: i for i, r in enumerate(sorted(listed, key=lambda r: r.feature))}
    by_name = {r.feature: r for r in listed}
    insults = {w: (0.8 * PRIOR) / PRIOR for w in INSULTS}
    if index:
        names = sorted(index)

        def used(batches):
            for b in batches:
                yield pa.record_batch([pa.array([sorted(index[f] for f in _features(t) if f in index) for t in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["used"])

        lists = [r[0] for r in rows.filter("toxic = 1").select("text").mapInArrow(used, "used array<int>").collect()]
        toxic = np.array([by_name[f].toxic for f in names])
        clean = np.array([by_name[f].clean for f in names])
        length = np.array([len(f) + (not f.endswith("*")) for f in names])
        for i in _cover(lists, toxic, clean, length, 3):
            insults[names[i]] = float((toxic[i] + 0.5) / (toxic[i] + clean[i] + 1.0))
    for w in INSULTS:
        if w in by_name or insults[w] == 0.8:
            seen = by_name.get(w)
            n, t = (seen.toxic + seen.clean, seen.toxic) if seen else (0, 0)
            insults[w] = max(insults[w], (0.8 * PRIOR + t) / (PRIOR + n))
    grammar = Grammar(insults, dict(PATHS))
    seen = {r.path: r for r in rows.mapInArrow(partial(_paths_of, grammar=grammar), "path string, toxic int").groupBy("path").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    for path, prior in PATHS.items():
        if path in seen:
            grammar.paths[path] = float((prior * PRIOR + seen[path].t) / (PRIOR + seen[path].n))
    if "none" in seen:
        grammar.base = float(min(0.45, (0.05 * PRIOR + seen["none"].t) / (PRIOR + seen["none"].n)))
    return grammar


def _scores(batches, grammar: Grammar):
    compiled = grammar.compiled()
    for b in batches:
        scores = [compiled.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.record_batch([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "score"])


def _spans(batches, grammar: Grammar):
    compiled = grammar.compiled()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("path", pa.string()), ("weight", pa.float64())]))
    for b in batches:
        found = [[dict(zip(("start", "end", "path", "weight"), m)) for m in compiled.matches(t or "")] for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(found, kind)], names=["doc_id", "matches"])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score``, a row per row; null and empty texts get the score of a text without a match."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scores, grammar=grammar), "doc_id long, score double")


def matched_spans(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, matches``: start, end, path and weight of each match in characters of the lowered text."""
    schema = "doc_id long, matches array<struct<start: int, end: int, path: string, weight: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_spans, grammar=grammar), schema)


def reject(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with their own columns."""
    def kept(batches):
        compiled = grammar.compiled()
        for b in batches:
            yield b.filter(pa.array([compiled.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
