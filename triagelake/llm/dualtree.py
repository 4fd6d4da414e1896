"""Ranked lexical search of all documents for each of a set of items by a dual-tree walk.

Documents are vectors of term impacts, items are sets of terms. Blocks of documents and the
items are each arranged in a hierarchy whose nodes hold the largest value of every coordinate
below them. The bound of a pair of nodes is the sum of their coordinates' products. A pair whose bound is under
the weakest k-th best score so far of the node's items holds no answer, and the whole batch
is left out; what remains is scored exactly. Impacts are whole numbers, so bounds and scores
have no rounding and ties are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.arrays import small, words_of
from triagelake.llm.store import materialize

#: Documents of a leaf, leaves of an inner node and documents of a tree.
LEAF, FAN, BLOCK = 16, 16, 4096
#: Items of a group, and items walked at a time.
GROUP, ITEMS = 8, 256
#: Item terms (with repeats) searched in one pass over the documents; more items take more passes.
SHARD_TERMS = 1 << 20
#: One document in so many is searched first; its k-th scores are lower bounds for the others.
SEED = 64

#: Everything but ASCII letters and digits and characters beyond ASCII parts terms.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)], bool)
#: Stands for a null id inside a task: after all others of a score.
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Items:
    """Terms of all items: item ``i`` has ``term[heads[i]:heads[i + 1]]``, distinct places in ``hashes``."""

    hashes: np.ndarray
    heads: np.ndarray
    term: np.ndarray


@dataclass
class Block:
    """Postings of some documents: document ``d`` has ``term[heads[d]:heads[d + 1]]`` with these impacts."""

    doc: np.ndarray
    heads: np.ndarray
    term: np.ndarray
    impact: np.ndarray


def _ranges(heads: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the postings of ``rows``, and which of the rows each belongs to."""
    n = heads[rows + 1] - heads[rows]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - heads[rows], n)
    return at, np.repeat(np.arange(len(rows)), n)


def item_sets(texts: pa.Array) -> Items:
    """The distinct terms of each item."""
    words = words_of(texts, gap=_GAP)
    row = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    hashes, code = np.unique(words.hash, return_inverse=True)
    key = np.unique(row.astype(np.int64) << 32 | code)
    return Items(hashes, np.searchsorted(key >> 32, np.arange(len(texts) + 1)), key & 0xFFFFFFFF)


class Best:
    """The k best (score, document) of each item so far; ``floor`` are scores that some documents are known to reach."""

    def __init__(self, items: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.least = np.ones(items, np.int64) if floor is None else np.maximum(floor, 1)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        last = rank == self.k - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])


def _dense(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int, kind: np.dtype) -> np.ndarray:
    """The largest value of each cell, 0 where there is none."""
    out = np.zeros((rows, columns), kind)
    np.maximum.at(out, (row, column), value.astype(kind))
    return out


def _ordered(block: Block) -> np.ndarray:
    """Documents by their two strongest terms, so that those of a leaf share their largest coordinates."""
    n = len(block.doc)
    row = np.repeat(np.arange(n), np.diff(block.heads))
    order = np.lexsort((-block.impact, row))
    place = np.arange(len(row)) - block.heads[row]
    strong = np.full((2, n), -1)
    for k in (0, 1):
        hit = order[place == k]
        strong[k, row[hit]] = block.term[hit]
    return np.lexsort((strong[1], strong[0]))


def search(block: Block, items: Items, best: Best, sizes: tuple[int, int, int, int] = (LEAF, FAN, GROUP, ITEMS)) -> int:
    """Add the documents of a block to the items' best; the number of (item, document) pairs scored."""
    leaf_size, fan, group_size, step = sizes
    order = _ordered(block)
    at, place = _ranges(block.heads, order)
    term, impact, doc = block.term[at], block.impact[at], block.doc[order]
    leaves = -(-len(doc) // (leaf_size * fan)) * fan
    scored = 0
    for lo in range(0, len(items.heads) - 1, step):
        hi = min(lo + step, len(items.heads) - 1)
        wanted = items.term[items.heads[lo] : items.heads[hi]]
        seen = np.zeros(len(items.hashes), bool)
        seen[wanted] = True
        own = seen[term]
        if not own.any():
            continue
        # Coordinates: the terms that both the items and some document of the block have.
        mark = np.zeros(len(items.hashes), bool)
        mark[term[own]] = True
        column = np.cumsum(mark) - 1
        t, p, v = column[term[own]], place[own], impact[own]
        width = int(mark.sum())
        top = np.zeros(width, np.int64)
        np.maximum.at(top, t, v)
        # Sums of whole numbers under 2**53 are exact in doubles, and those multiply faster.
        kind = np.dtype(np.float64 if int(top.sum()) < 1 << 53 else np.int64)
        leaf = _dense(p // leaf_size, t, v, leaves, width, kind)
        node = leaf.reshape(-1, fan, width).max(axis=1)
        groups = -(-(hi - lo) // group_size)
        which = np.repeat(np.arange(hi - lo), np.diff(items.heads[lo : hi + 1]))
        has = mark[wanted]
        item = np.zeros((groups * group_size, width), kind)
        item[which[has], column[wanted[has]]] = 1
        group = item.reshape(groups, group_size, width).max(axis=1)
        if (group.max(axis=0) * node.max(axis=0)).sum() < best.least[lo:hi].min():
            continue
        bound = group @ node.T
        heads = np.searchsorted(p, np.arange(0, leaves * leaf_size + 1, leaf_size * fan))
        for m in np.argsort(-bound.max(axis=0), kind="stable"):
            least = np.full(groups * group_size, _NO_ID)
            least[: hi - lo] = best.least[lo:hi]
            alive = np.flatnonzero(bound[:, m] >= least.reshape(groups, group_size).min(axis=1))
            if not len(alive):
                continue
            rows = (alive[:, None] * group_size + np.arange(group_size)).ravel()
            rows = rows[rows < hi - lo]
            near = item[rows] @ leaf[m * fan : (m + 1) * fan].T >= least[rows][:, None]
            rows, near = rows[near.any(axis=1)], near[near.any(axis=1)]
            wide = np.flatnonzero(near.any(axis=0))
            if not len(wide):
                continue
            slot = np.full(fan, -1)
            slot[wide] = np.arange(len(wide))
            cut = slice(heads[m], heads[m + 1])
            inner = p[cut] - m * leaf_size * fan
            kept = slot[inner // leaf_size] >= 0
            inner = inner[kept]
            spot = slot[inner // leaf_size] * leaf_size + inner % leaf_size
            docs = np.zeros((len(wide) * leaf_size, width), kind)
            docs[spot, t[cut][kept]] = v[cut][kept]
            score = (item[rows] @ docs.T).astype(np.int64)
            open_ = np.repeat(near[:, wide], leaf_size, axis=1)
            scored += int(open_.sum())
            r, d = np.nonzero(open_ & (score >= least[rows][:, None]))
            if len(r):
                best.add(rows[r] + lo, score[r, d], doc[(m * fan + wide[d // leaf_size]) * leaf_size + d % leaf_size])
    return scored


def _postings(batches, hashes: np.ndarray):
    for b in small(batches, 1):
        words = words_of(b.column(1), gap=_GAP)
        n = np.diff(words.bounds)
        at = np.searchsorted(hashes, words.hash)
        at[at == len(hashes)] = 0
        hit = np.flatnonzero(hashes[at] == words.hash) if len(hashes) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(b.num_rows), n)[hit]
        key, tf = np.unique(row.astype(np.int64) << 32 | at[hit], return_counts=True)
        heads = pa.array(np.searchsorted(key >> 32, np.arange(b.num_rows + 1)), pa.int32())
        terms = pa.ListArray.from_arrays(heads, pa.array(key & 0xFFFFFFFF, pa.int32()))
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), terms, pa.ListArray.from_arrays(heads, pa.array(tf, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])


def postings(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``doc_id``, number of terms ``n``, and of the terms ``hashes`` those it holds with their occurrences; a row for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_postings, hashes=hashes), "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _blocks(batches, weight: np.ndarray, documents: int, length: int, most: int = BLOCK):
    """The batches gathered into blocks of ``most`` documents with impacts; documents without any item term are left out."""
    held, count = [], 0

    def block():
        tables = pa.Table.from_batches(held)
        doc, terms, tfs = (tables.column(k).combine_chunks() for k in ("doc_id", "terms", "tfs"))
        size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs))
        m = 10 + 90 * tables.column("n").to_numpy() * documents // length
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size)))
        return Block(doc.fill_null(_NO_ID).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)), term, impact)

    for b in batches:
        b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, most - count)
            held.append(part)
            lo, count = lo + part.num_rows, count + part.num_rows
            if count == most:
                yield block()
                held, count = [], 0
    if count:
        yield block()


def _best(batches, items: Items, k: int, floor: np.ndarray, weight: np.ndarray, documents: int, length: int):
    best = Best(len(items.heads) - 1, k, floor)
    for block in _blocks(batches, weight, documents, length):
        search(block, items, best)
    if len(best.item):
        doc = pa.array(best.doc, mask=best.doc == _NO_ID)
        yield pa.record_batch([pa.array(best.item, pa.int32()), doc, pa.array(best.score)], names=["item", "doc_id", "score"])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each item with a score above 0.

    Each row of ``items`` and of ``docs`` counts on its own: repeated rows give repeated results.
    Equal scores are ranked by ascending id, null ids last. Null and empty texts have no terms: such items have no rows,
    such documents are in no result, and documents without a term are not counted. Other columns are not read; an
    empty table gives none. Items are dealt by hash into shards of some ``shard_terms`` terms; the
    driver and the tasks hold one shard's terms and k results an item at a time, and each
    shard reads the documents once. Documents never leave the task that reads them; only results are shuffled.
    """
    spark = docs.sparkSession
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    listed = materialize(listed.withColumn("at", F.monotonically_increasing_id()), "items")
    terms = listed.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    shards = -(-(terms or 0) // shard_terms)
    results = []
    for s in range(shards):
        own = listed.filter(F.pmod(F.xxhash64("at"), F.lit(shards)) == s).toArrow()
        if not own.num_rows:
            continue
        sets = item_sets(own.column("text").combine_chunks())
        held = materialize(postings(docs, sets.hashes), "postings")
        documents, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not len(sets.hashes):
            continue
        df = np.zeros(len(sets.hashes), np.int64)
        counted = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
        weight = weights(df, documents)
        sets, own = by_rarest(sets, own, df)
        walk = partial(_best, items=sets, k=k, weight=weight, documents=documents, length=length)
        schema = "item int, doc_id long, score long"
        floor = np.ones(own.num_rows, np.int64)
        first = held.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEED)) == 0).mapInArrow(partial(walk, floor=floor), schema)
        known = _ranked(first, k).filter(F.col("rank") == k).select("item", "score").toArrow()
        floor[known.column(0).to_numpy()] = known.column(1).to_numpy()
        found = _ranked(held.mapInArrow(partial(walk, floor=floor), schema), k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(own.num_rows), pa.int32()), "item_id": own.column("item_id")}))
        results.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def by_rarest(items: Items, own: pa.Table, df: np.ndarray) -> tuple[Items, pa.Table]:
    """The items ordered by their rarest term that some document holds, so that a group's terms overlap."""
    n = len(items.heads) - 1
    rare = np.full(n, len(items.hashes))
    row = np.repeat(np.arange(n), np.diff(items.heads))
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((np.arange(len(df)), np.where(df > 0, df, _NO_ID)))] = np.arange(len(df))
    np.minimum.at(rare, row, rank[items.term])
    order = np.argsort(rare, kind="stable")
    at, which = _ranges(items.heads, order)
    return Items(items.hashes, np.searchsorted(which, np.arange(n + 1)), items.term[at]), own.take(pa.array(order))
