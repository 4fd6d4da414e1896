"""Benchmark items found in training documents: a BM25 index of the items, searched by block-max WAND.

Every passage of every document is a query against the inverted index of the items. Items are
kept in blocks with the largest impact of each term in a block, so the sum of these bounds a
passage's score in the block. Terms common among items are left to the end: only their
bound counts while candidates are sought. Passages whose bound reaches the lowest threshold of a block are
scored exactly there, and every item above its threshold is verified by the overlap of its question and of its answer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import runs, small, words_of

K1, B = 1.2, 0.75
#: Items of a block: the fewer, the tighter the bounds.
BLOCK = 4
#: Terms whose bounds are gathered at a time.
STEP = 1 << 16
#: Share of an item's score against itself from which a passage is retrieved.
RETRIEVE = 0.5
#: Share of the word sequences of the question, and of the answer, that must be in the document.
OVERLAP = 0.7
#: Words of such a sequence.
GRAM = 4
#: An answer of fewer words has too few sequences for a share of them; its words next to the question count as well.
FEW = 10
#: Share of the lowest threshold that the terms left to the end may add up to.
LATE = 0.3
#: Bytes of item text indexed at a time; larger benchmarks are searched shard by shard.
SHARD_BYTES = 16 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: split after its last question mark, else before its last sentence."""
    at = text.rfind("?")
    if at >= 0 and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    parts = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    return (text[: parts[-1]], text[parts[-1] :]) if parts else (text, "")


def _grams(text: str) -> np.ndarray:
    h = words_of(pa.array([text]), signs=True).hash
    return np.unique(runs(h, min(GRAM, len(h)))) if len(h) else h


def _short(answer: str) -> np.ndarray:
    h = words_of(pa.array([answer]), signs=True).hash
    return np.unique(h) if len(h) < FEW else h[:0]


def _beside(window: np.ndarray, grams: np.ndarray, question: np.ndarray, answer: np.ndarray) -> float:
    """Share of the words of a short answer that stand in the question's stretch of a passage, or at most ``FEW`` words before or after it."""
    at = np.flatnonzero(np.isin(grams, question))
    if not len(at):
        return 0.0
    return float(np.isin(answer, window[max(0, at[0] - FEW) : at[-1] + GRAM + FEW]).mean())


@dataclass
class Index:
    ids: np.ndarray
    terms: np.ndarray
    idf: np.ndarray
    heads: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    own: np.ndarray
    bounds: np.ndarray
    late: np.ndarray
    late_bound: np.ndarray
    needed: np.ndarray
    stride: int
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    #: Distinct words of the short answers; empty for others.
    short: list[np.ndarray]


def build(rows: list[tuple[int, str]]) -> Index | None:
    """The index of items with words; None without any."""
    words = words_of(pa.array([t for _, t in rows], pa.string()), signs=True)
    length = np.diff(words.bounds)
    keep = np.flatnonzero(length)
    if not len(keep):
        return None
    rank = np.full(len(rows), -1)
    rank[keep] = np.arange(len(keep))
    owner = np.repeat(rank, length)
    terms, tid = np.unique(words.hash, return_inverse=True)
    pair, tf = np.unique(tid.astype(np.int64) * len(keep) + owner, return_counts=True)
    term, item = pair // len(keep), pair % len(keep)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((len(keep) - df + 0.5) / (df + 0.5))
    size = length[keep]
    impact = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / size.mean()))).astype(np.float32)
    own = np.bincount(item, impact, minlength=len(keep))
    blocks = -(-len(keep) // BLOCK)
    bounds = np.zeros((len(terms), blocks), np.float32)
    np.maximum.at(bounds, (term, item // BLOCK), impact)
    needed = np.array([own[b * BLOCK : (b + 1) * BLOCK].min() * RETRIEVE for b in range(blocks)])
    order = np.argsort(idf, kind="stable")
    within = np.cumsum(bounds[order], axis=0) <= LATE * needed
    late = np.zeros(len(terms), bool)
    late[order[np.logical_and.accumulate(within.all(axis=1))]] = True
    texts = [rows[i][1] for i in keep]
    split = [question_and_answer(t) for t in texts]
    return Index(
        np.array([rows[i][0] if rows[i][0] is not None else -1 for i in keep]),
        terms, idf, np.searchsorted(term, np.arange(len(terms) + 1)), item, impact, own, bounds, late, bounds[late].sum(axis=0), needed, int(size.max()),
        [_grams(q) for q, _ in split], [_grams(a) for _, a in split], [_short(a) for _, a in split],
    )


def search(texts: pa.Array, index: Index) -> list[tuple[int, int, float, float, float, int, int]]:
    """``row, item, score, question overlap, answer overlap, first word, last word`` of the best passage of each row and item."""
    words = words_of(texts, signs=True)
    tid = np.searchsorted(index.terms, words.hash)
    tid[tid == len(index.terms)] = 0
    at = np.flatnonzero(index.terms[tid] == words.hash)
    if not len(at):
        return []
    length = np.diff(words.bounds)
    # Passages of two strides, one stride apart: each item fits wholly into one.
    passages = -(-length // index.stride)
    offset = np.concatenate([[0], np.cumsum(passages)])
    row = np.repeat(np.arange(len(length)), length)[at]
    local = (at - words.bounds[row]) // index.stride
    early = ~index.late[tid[at]]
    here, known = offset[row[early]] + local[early], tid[at][early].astype(np.int64)
    back = local[early] > 0
    t = len(index.terms)
    pair = np.unique(np.concatenate([here * t + known, (here[back] - 1) * t + known[back]]))
    if not len(pair):
        return []
    passage, term = pair // t, pair % t
    head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    floor = (index.needed * (1 - 1e-5) - index.late_bound).astype(np.float32)
    parts, lo = [], 0
    while lo < len(head):
        hi = max(lo + 1, int(np.searchsorted(head, head[lo] + STEP)))
        stop = head[hi] if hi < len(head) else len(term)
        bound = np.add.reduceat(index.bounds[term[head[lo] : stop]], head[lo:hi] - head[lo], axis=0)
        parts.append(np.argwhere(bound >= floor) + (lo, 0))
        lo = hi
    hits = np.concatenate(parts)
    best: dict[tuple[int, int], tuple] = {}
    last, score = -1, None
    for k, block in hits:
        if k != last:
            number = int(passage[head[k]])
            r = int(np.searchsorted(offset, number, side="right") - 1)
            begin = int(words.bounds[r] + (number - offset[r]) * index.stride)
            end = int(min(begin + 2 * index.stride, words.bounds[r + 1]))
            window = words.hash[begin:end]
            mine = np.unique(tid[begin:end][index.terms[tid[begin:end]] == window])
            size = index.heads[mine + 1] - index.heads[mine]
            posts = np.repeat(index.heads[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
            score = np.bincount(index.items[posts], index.impacts[posts], minlength=len(index.ids))
            grams, last = None, k
        for i in range(block * BLOCK, min((block + 1) * BLOCK, len(index.ids))):
            if score[i] < RETRIEVE * index.own[i] * (1 - 1e-6):
                continue
            if grams is None:
                grams = {}
            overlaps = []
            for wanted in (index.questions[i], index.answers[i]):
                if not len(wanted):
                    overlaps.append(1.0)
                    continue
                total = 0
                for n in range(1, GRAM + 1):
                    if n not in grams:
                        grams[n] = runs(window, n)
                total = max(np.isin(wanted, grams[n]).mean() for n in (GRAM, *range(1, GRAM))) if len(wanted) == 1 else np.isin(wanted, grams[GRAM]).mean()
                overlaps.append(float(total))
            if overlaps[0] >= OVERLAP > overlaps[1] and len(index.short[i]):
                overlaps[1] = max(overlaps[1], _beside(window, grams[GRAM], index.questions[i], index.short[i]))
            if min(overlaps) >= OVERLAP and ((r, i) not in best or best[r, i][2] < score[i]):
                best[r, i] = (r, i, float(score[i]), *overlaps, begin - int(words.bounds[r]), end - int(words.bounds[r]) - 1)
    return [best[k] for k in sorted(best)]


def shards(benchmark: DataFrame) -> list[Index]:
    """Indexes of all items, each over at most about ``SHARD_BYTES`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // SHARD_BYTES)
    out = []
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = build(sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
        if index is not None:
            out.append(index)
    return out


_FOUND = "doc_id long, item_id long, score double, share double, question_overlap double, answer_overlap double, first_word int, last_word int"


def _found(batches, index: Index):
    for b in small(batches, 1):
        rows = search(b.column(1), index)
        cols = list(zip(*rows)) if rows else [[]] * 7
        at, item = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
        score = np.array(cols[2], np.float64)
        yield pa.record_batch(
            [b.column(0).take(pa.array(at)), pa.array(index.ids[item]), pa.array(score), pa.array(score / index.own[item]), *[pa.array(np.array(c, np.float64)) for c in cols[3:5]], *[pa.array(np.array(c, np.int32)) for c in cols[5:7]]],
            names=["doc_id", "item_id", "score", "share", "question_overlap", "answer_overlap", "first_word", "last_word"],
        )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: BM25 score, share of the item's own score, overlaps, and the words of the passage.

    A passage is retrieved if its score is at least half of the item's score against itself,
    and holds the item if at least ``OVERLAP`` of the four-word sequences of both its question and its
    answer are in it; of an answer of fewer than ``FEW`` words, that share of its words beside the question is enough.
    Words end at blanks and at punctuation and symbols of any script, in items and documents alike. Null and wordless texts and items match nothing; repeated rows give repeated results;
    an item with a null id is reported as -1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in shards(benchmark):
        part = rows.mapInArrow(partial(_found, index=index), _FOUND)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], _FOUND)


def _clean(batches, index: Index, column: int):
    for b in small(batches, column):
        keep = np.ones(b.num_rows, bool)
        keep[[r[0] for r in search(b.column(column), index)]] = False
        yield b.filter(pa.array(keep))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    for index in shards(benchmark):
        docs = docs.mapInArrow(partial(_clean, index=index, column=docs.columns.index("text")), docs.schema)
    return docs
