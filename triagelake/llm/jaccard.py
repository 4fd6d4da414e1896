"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Two sets of at most ``b`` elements with Jaccard similarity of at least ``t`` differ in at most
``H = 2b(1-t)/(1+t)`` elements. If every possible element is hashed to one of ``m``
segments, each differing element spoils at most one, so at least ``need = m - H``
segments of the two sets are equal. Sets are put into bands by size, each band has its own
``m``, and a set is indexed in its own band and in the next, where its larger partners are.
All cost figures are counts of those equal segments:

* A segment shared by few sets (``FEW``) yields its pairs, with a count of 1 each.
* A segment without an element, or shared by more sets, yields no pairs. It is only
  counted per set. A pair can reach ``need`` only if its count of pairs plus the smaller
  of its two counts of empty and crowded segments does; all others are dropped.
* A pair equal in empty and crowded segments alone has ``need`` of them in both sets. Only
  such sets are looked at again: those that meet in a crowded segment (or both
  have ``need`` empty ones) are put into one group.

This is the allocation of cost: crowded segments, where one-deletion neighbourhoods would be larger
still, are paid for with the ``need`` that a larger ``m`` buys, and the small sets, where few segments
are available, by one-deletion neighbourhoods of the whole set (:func:`_deletions`).
Surviving pairs and groups form candidate components, inside of which all sets are
compared exactly, block against block, without listing pairs; only spanning links leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import U64, deal, forest, mix, pack, shingle_set, small, unpack, words_of
from triagelake.llm.components import components
from triagelake.llm.store import materialize, shuffle_parts
from triagelake.llm.urls import bloom, maybe

#: Bands of set sizes grow by this factor; a partner is at most one band away for t >= 1 / GROWTH.
GROWTH = 1.25
#: Sets sharing a segment whose pairs are listed one by one.
FEW = 16
#: Sets of a candidate component compared at a time, and shingles of a step of a comparison.
BLOCK = 256
STEP = 4096
#: Sets up to this size are found by their one-deletion neighbourhoods instead of segments.
SMALL = 8

_SEED = U64(0x5851F42D4C957F2D)


def _seed(k: int) -> np.uint64:
    return U64(int(_SEED) * k & (1 << 64) - 1)


def band_of(size: int) -> int:
    return int(math.floor(math.log(size) / math.log(GROWTH) + 1e-9)) if size else -1


def differing(sizes: int, percent: int) -> int:
    """Elements in which two linked sets of at most ``sizes`` elements together may differ."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def layout(band: int, percent: int) -> tuple[int, int]:
    """``m, need`` of a band: the smallest ``m`` whose empty segments almost never reach ``need`` in any set indexed there."""
    top = int(math.ceil(GROWTH ** (band + 1)))
    low = max(1, int(GROWTH ** (band - 1)))
    differ = differing(2 * top, percent)
    m = differ + 2
    while m < 40 * (differ + 2):
        fill = low / m
        empty = m * math.exp(-fill)
        spread = math.sqrt(max(m * (math.exp(-fill) - (1 + fill) * math.exp(-2 * fill)), 0.25))
        if m - differ >= empty + 4.5 * spread + 1:
            break
        m += max(1, m // 64)
    return m, m - differ


def node_of(shingles: np.ndarray) -> int:
    """A set's name: a 62-bit hash of all its elements and their number. Bit 0 stays free."""
    if not len(shingles):
        return 0
    h = mix(np.array([np.add.reduce(mix(shingles)) + U64(len(shingles))], U64))[0]
    return int((h >> U64(2)) << U64(1)) or 2


def _segments(shingles: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the set's segments that have elements."""
    seg = mix(shingles + _seed(band + 1)) % U64(m)
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], mix(shingles[order] ^ _SEED)
    head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
    return mix(np.add.reduceat(value, head) + seg[head] * _SEED + U64(band))


def _deletions(shingles: np.ndarray) -> np.ndarray:
    """Names of the set and of all sets with one element less."""
    value = mix(shingles ^ _SEED)
    total = np.add.reduce(value)
    return mix(np.append(total - value, total) + U64(7))


def _sets(batch: pa.RecordBatch, column: int = 1, size: int = 5) -> Iterator[np.ndarray]:
    words = words_of(batch.column(column))
    edges = words.bounds
    for i in range(batch.num_rows):
        yield shingle_set(words.hash[edges[i] : edges[i + 1]], size)


def _describe(batches):
    """doc_id, text, text_hash -> doc_id, text_hash, n_shingles, node."""
    for b in small(batches, 1):
        sets = [(len(s), node_of(s)) for s in _sets(b)]
        yield pa.record_batch([b.column(0), b.column(2), pa.array([n for n, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.int64())], names=["doc_id", "text_hash", "n_shingles", "node"])


class _Entries:
    """Index entries of a batch, dealt to partitions by segment."""

    def __init__(self, parts: int):
        self.parts, self.sigs, self.nodes, self.bands = parts, [], [], []

    def add(self, sigs, node, band):
        self.sigs.append(sigs)
        self.nodes.append(np.full(len(sigs), node, np.int64))
        self.bands.append(np.full(len(sigs), band, np.uint8))

    def rows(self):
        if not self.sigs:
            return
        sig, node, band = map(np.concatenate, (self.sigs, self.nodes, self.bands))
        for p, at in deal((sig >> U64(33)) % U64(self.parts), self.parts):
            own = node[at]
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            yield p, pack(sig[at].astype(np.uint32)), pack(band[at]), pack(own[head]), pack(np.diff(np.append(head, len(own))).astype(np.uint32))


_ENTRY = "part int, sigs binary, bands binary, nodes binary, counts binary"
#: kind 0: a pair with its count; 1: a set in a crowded segment (v); 2: empty segments of a set (n).
_FOUND = "kind int, u long, v long, band int, n long"


def _index(batches, parts: int, percent: int):
    for b in small(batches, 1):
        out = _Entries(parts)
        seen = set()
        for s in _sets(b):
            node = node_of(s)
            if not node or node in seen:
                continue
            seen.add(node)
            own = band_of(len(s))
            if len(s) <= SMALL + 2:
                out.add(_deletions(s), node | 1, 255)
            if len(s) > SMALL - 2:
                for band in (own, own + 1):
                    out.add(_segments(s, band, layout(band, percent)[0]), node | (band == own), band)
        rows = list(out.rows())
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["part", "sigs", "bands", "nodes", "counts"])


def _pairs_of(width: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.triu_indices(width, 1)
    return a, b


def _meet(table: pa.Table) -> pa.Table:
    """All entries of a partition -> pairs with counts, and members of crowded segments."""
    part = table.column(0)[0].as_py()
    cols = [[unpack(x, t) for x in table.column(k).to_pylist()] for k, t in ((1, np.uint32), (2, np.uint8), (3, np.int64), (4, np.uint32))]
    key = np.concatenate(cols[0]).astype(U64) << U64(8) | np.concatenate(cols[1])
    node = np.concatenate([np.repeat(n, c) for n, c in zip(cols[2], cols[3])])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    # A set met twice counts once; bit 0 of a node says that the band is its own.
    keep = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node = key[keep], node[keep]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(head, len(key)))
    us, vs, bs = [], [], []
    small = (size > 1) & (size <= FEW)
    for width in np.unique(size[small]):
        a, b = _pairs_of(int(width))
        rows = head[small & (size == width)]
        u, v = node[rows[:, None] + a], node[rows[:, None] + b]
        band = np.broadcast_to((key[rows] & U64(255))[:, None], u.shape)
        ok = (u | v) & 1 == 1
        us.append(u[ok] & ~1)
        vs.append(v[ok] & ~1)
        bs.append(band[ok])
    none = np.zeros(0, np.int64)
    u, v, band = (np.concatenate(x) if x else none for x in (us, vs, [b.astype(np.int64) for b in bs]))
    low, high = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((band, high, low))
    low, high, band = low[order], high[order], band[order]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (band[1:] != band[:-1]))) if len(low) else none
    count = np.diff(np.append(first, len(low))) if len(low) else none
    crowd = np.repeat(size > FEW, size)
    ckey, cnode = key[crowd], node[crowd] & ~1
    cname = mix(ckey + _seed(part)).view(np.int64) | 1
    cols = [
        (np.zeros(len(first), np.int32), low[first], high[first], band[first].astype(np.int32), count),
        (np.ones(len(cnode), np.int32), cnode, cname, (ckey & U64(255)).astype(np.int32), np.ones(len(cnode), np.int64)),
    ]
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*cols)], schema=pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("band", pa.int32()), ("n", pa.int64())]))


def _empties(batches, percent: int):
    """node, band, need, empty segments: what a set can be equal in without any element."""
    for b in small(batches, 1):
        rows = []
        for s in _sets(b):
            if len(s) <= SMALL - 2:
                continue
            own, node = band_of(len(s)), node_of(s)
            for band in (own, own + 1):
                m, need = layout(band, percent)
                rows.append((node, band, need, m - len(np.unique(mix(s + _seed(band + 1)) % U64(m)))))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["node", "band", "need", "empty"])


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """All sets of a block, or of two, against each other -> spanning links."""
    # Repeated rows bring a set more than once.
    _, once = np.unique(table.column("node").to_numpy(), return_index=True)
    table = table.take(pa.array(np.sort(once)))
    node = table.column("node").to_numpy()
    side = table.column("side").to_numpy()
    sets = [unpack(x, U64) for x in table.column("shingles").to_pylist()]
    if len(node) == 1:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(head) - 1
    several = np.bincount(column) > 1
    keep = several[column]
    column, owner = (np.cumsum(several) - 1)[column[keep]], owner[keep]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    lo, total = 0, int(several.sum())
    for start in range(0, total, STEP):
        hi = np.searchsorted(column, start + STEP)
        dense = np.zeros((len(sets), min(STEP, total - start)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - start] = 1
        shared += dense @ dense.T
        lo = hi
    inter = shared.astype(np.int64)
    ok = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if (side == 1).any() and (side == 0).any():
        ok &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(ok, 1))
    if not len(a):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    u, v = forest(node[a], node[b])
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


def _comparison(percent: int):
    def run(table: pa.Table) -> pa.Table:
        return _compare(table, percent)

    return run


def _shingle_blobs(batches, shared):
    """key, text -> node and shingles of the rows whose key may be a chosen one."""
    for b in batches:
        chosen = b.filter(pa.array(maybe(b.column(0).to_numpy(zero_copy_only=False), shared.value))) if b.num_rows else b
        for part in small([chosen], 1):
            sets = list(_sets(part))
            yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([pack(s) for s in sets], pa.binary())], names=["node", "shingles"])


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node``: the size of each document's set and the name equal sets share (0: empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_describe, "doc_id long, text_hash long, n_shingles long, node long")


def candidate_links(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``u, v``: edges between sets (or a set and a crowded segment); linked sets are in one component of them."""
    parts = shuffle_parts(docs)
    text = docs.select("doc_id", "text")
    entries = text.mapInArrow(partial(_index, parts=parts, percent=percent), _ENTRY)
    found = materialize(entries.groupBy("part").applyInArrow(_meet, _FOUND), "met")
    idle = text.mapInArrow(partial(_empties, percent=percent), "node long, band long, need long, empty long").distinct()
    crowd = found.filter("kind = 1 and band < 255")
    crowded = crowd.groupBy(F.col("u").alias("node"), F.col("band").cast("long").alias("band")).agg(F.sum("n").alias("crowded"))
    idle = materialize(idle.join(crowded, ["node", "band"], "left").select("node", "band", "need", "empty", (F.col("empty") + F.coalesce("crowded", F.lit(0))).alias("idle")), "idle")

    pairs = found.filter("kind = 0")
    direct = pairs.filter("band = 255").select("u", "v")
    counted = pairs.filter("band < 255").groupBy("u", "v", F.col("band").cast("long").alias("band")).agg(F.sum("n").alias("n"))
    left, right = idle.selectExpr("node as u", "band", "need", "idle as iu"), idle.selectExpr("node as v", "band", "idle as iv")
    # The count alone mostly decides; only what might still reach the need is joined.
    near = counted.join(left, ["u", "band"]).filter("n + iu >= need").join(right, ["v", "band"]).filter("n + least(iu, iv) >= need").select("u", "v")

    again = idle.filter("idle >= need").selectExpr("node as u", "cast(band as int) as band")
    meeting = crowd.join(again, ["u", "band"]).select("u", "v")
    small = found.filter("kind = 1 and band = 255").select("u", "v")
    # Sets that could be equal in empty segments alone meet in a name of their band.
    bare = idle.filter("empty >= need").select(F.col("node").alias("u"), (F.xxhash64("band").bitwiseOR(F.lit(1))).alias("v"))
    return near.union(direct).union(meeting).union(small).union(bare)


def exact_links(docs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """``u, v``: spanning links of the sets of each candidate component; ``sets`` has ``node, component`` and names one document of each."""
    # Only documents that pass a filter of the chosen ones become shingles, and only shingles are shuffled.
    field = docs.sparkSession.sparkContext.broadcast(bloom(sets.select(F.xxhash64("doc_id", "text_hash").alias("key"))))
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")
    blobs = keyed.mapInArrow(partial(_shingle_blobs, shared=field), "node long, shingles binary")
    # A component of many sets is dealt into blocks by hash; each pair of blocks is one task.
    wide = sets.groupBy("component").agg(F.count("*").alias("members"))
    named = sets.join(wide, "component").withColumn("salts", F.ceil(F.col("members") / BLOCK).cast("int"))
    blocked = named.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("salts")).cast("int")).select("node", "component", "block", "salts")
    joined = blobs.join(blocked, "node")
    left = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    tasks = left.select(
        "component",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        "node",
        "shingles",
    )
    return tasks.groupBy("component", "i", "j").applyInArrow(_comparison(percent), "u long, v long")


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """:func:`describe` of the documents, and ``node, component, component_id`` of their sets."""
    if percent < 80:
        raise ValueError("bands of sizes and neighbourhoods of small sets hold from 80 per cent on")
    meta = materialize(describe(docs), "sets")
    edges = materialize(candidate_links(docs, percent).filter("u <> v"), "candidates")
    near = components(edges).toDF("node", "component")
    first = meta.filter("node <> 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("d")).select("node", "d.*")
    # Names of segments are odd, names of sets are even.
    sets = first.join(near.filter("node % 2 = 0"), "node")
    many = sets.join(sets.groupBy("component").count().filter("count > 1").select("component"), "component").select("node", "component", "doc_id", "text_hash")
    many = materialize(many, "candidates")
    links = materialize(exact_links(docs, many, percent), "links")
    final = components(links)
    class_id = meta.filter("node <> 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = class_id.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return meta, materialize(named.join(lowest, "component").select("node", "component", "component_id"), "classes")


def join_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row per document.

    Documents whose sets of distinct five-word shingles have a Jaccard similarity of at least
    ``percent`` / 100 link (80 or more; less raises ``ValueError``); the component is the smallest doc_id reachable. Null, empty and
    wordless texts have no shingles and link with nothing. Repeated rows each get a row.
    A document with a null id can link others; a component of null ids only has a null name.
    Extra columns are not read.
    """
    meta, of_node = _classes(docs, percent)
    rows = meta.join(of_node, "node", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents stays: that with the smallest id (null ids last), then text hash.

    Rows are told apart by id and text, so of two texts that share an id only the one that is a copy goes, and of repeated rows
    of the kept one a single row stays. Documents without words are in no group and all stay. The columns are those of ``docs``.
    """
    meta, of_node = _classes(docs, percent)
    rows = meta.filter("node <> 0").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    rows = rows.join(of_node.select("node", "component"), "node").withColumn("order", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    first = rows.groupBy("component").agg(F.min("order").alias("first"))
    marked = rows.join(first, "component").select(F.struct("doc_id", "text_hash").alias("__row"), (F.col("order") == F.col("first")).alias("kept"), "rows")
    marked = materialize(marked.filter("not kept or rows > 1").select("__row", "kept"), "marked")
    named = docs.withColumn("__row", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")))
    single = named.join(marked.select("__row"), "__row", "left_anti")
    repeated = named.join(marked.filter("kept").select("__row"), "__row", "left_semi").dropDuplicates(["__row"])
    return single.unionByName(repeated).select(*docs.columns)
