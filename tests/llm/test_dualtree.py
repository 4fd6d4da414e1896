"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from messy import docs, messy_rows, no_docs  # noqa: F401
from pyspark.sql import functions as F

from triagelake.llm import dualtree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(documents, items, k):
    """``item_id, rank, doc_id, score`` by the definition."""
    bags = [Counter(terms(t)) for _, t in documents]
    total, count = sum(sum(b.values()) for b in bags), sum(1 for b in bags if b)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag in zip(documents, bags):
            if not bag:
                continue
            m = 10 + 90 * sum(bag.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(messy_rows):
    texts = [t for _, t, *_ in messy_rows if t]
    cut = lambda t, n: " ".join(t.split()[:n])
    return [(1, cut(texts[0], 30)), (2, "école, OÙ ß?"), (3, None), (4, ""), (5, "!!! --"), (6, "nothing-here zzzz9"), (None, cut(texts[1], 4)), (1, "x y z"), (8, texts[10])] + [
        (20 + i, cut(t, 12)) for i, t in enumerate(texts[-20:])
    ]


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_search_equals_scoring_all(table, docs, messy_rows, items, shard):
    found = dualtree.top_documents(docs.withColumn("score", F.lit(1)), table(items, "item_id long, text string"), 10, shard)
    assert got(found) == plain([r[:2] for r in messy_rows], items, 10)


def test_empty_tables(table, docs, no_docs, items):
    bench = table(items, "item_id long, text string")
    for a, b in ((no_docs, bench), (docs, bench.filter("false")), (docs.withColumn("text", F.lit(None).cast("string")), bench)):
        out = dualtree.top_documents(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_prune_and_keep_ties(seed):
    """Small nodes over topical documents with many equal ones: exact results from a fraction of the pairs."""
    rng = random.Random(seed)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(12)]
    common = [f"c{i}" for i in range(8)]
    documents = []
    for i in range(900):
        words = rng.choices(rng.choice(topics), k=rng.randrange(1, 9)) + rng.choices(common, k=rng.randrange(0, 6))
        documents.append((rng.randrange(10_000), " ".join(words)))
    documents += [(20_000 + i, documents[i % 5][1]) for i in range(60)]
    wanted = [(i, " ".join(rng.choices(topics[i % 12], k=5) + rng.choices(common, k=1))) for i in range(40)]
    sets = dualtree.item_sets(pa.array([t for _, t in wanted]))
    rows = pa.record_batch([pa.array([d for d, _ in documents]), pa.array([t for _, t in documents])], names=["doc_id", "text"])
    held = list(dualtree._postings([rows], sets.hashes))
    n = held[0].column("n").to_numpy()
    df = np.bincount(held[0].column("terms").flatten().to_numpy(), minlength=len(sets.hashes))
    weight = dualtree.weights(df, int((n > 0).sum()))
    sets, own = dualtree.by_rarest(sets, pa.table({"item_id": [i for i, _ in wanted]}), df)
    best = dualtree.Best(len(wanted), 10)
    scored = 0
    for block in dualtree._blocks(held, weight, int((n > 0).sum()), int(n.sum()), 256):
        scored += dualtree.search(block, sets, best, (4, 4, 2, 16))
    names = own.column("item_id").to_pylist()
    ranks = np.arange(len(best.item)) - np.searchsorted(best.item, best.item) + 1
    have = sorted(((names[i], int(r), int(d), int(s)) for i, r, d, s in zip(best.item, ranks, best.doc, best.score)), key=repr)
    assert have == plain(documents, wanted, 10)
    assert scored < 0.4 * len(wanted) * len(documents)


def test_large_sums_stay_exact():
    """Sums beyond 2**53 are taken in whole numbers."""
    n = 40
    heads = np.arange(0, (n + 1) * 3, 3)
    impact = np.array([(1 << 53) + i for i in range(3 * n)])
    block = dualtree.Block(np.arange(n), heads, np.tile(np.arange(3), n), impact)
    best = dualtree.Best(1, 3)
    dualtree.search(block, dualtree.Items(np.arange(3, dtype=np.uint64), np.array([0, 3]), np.arange(3)), best)
    assert best.doc.tolist() == [39, 38, 37] and best.score.tolist() == [int(impact[3 * d : 3 * d + 3].sum()) for d in (39, 38, 37)]
