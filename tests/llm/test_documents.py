"""The document operators against brute force, over rows with nulls, copies, ties and long texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from messy import docs, messy_rows, no_docs  # noqa: F401

from triagelake.llm import classlm, jaccard, lines, mixing

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLANK = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, messy_rows):
    sets = [(d, shingles(t)) for d, t, *_ in messy_rows]
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        low[find(i)].append(d)
    want = [(d, len(s), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets)]
    got = [tuple(r) for r in jaccard.join_documents(docs).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_jaccard_empty(no_docs):
    assert jaccard.join_documents(no_docs).count() == 0


def test_jaccard_keeps_one_of_each_group(docs):
    kept = jaccard.keep_one(docs)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert 1 in ids and not ids & {2, 3, 9} and {5, 6, 7, 8, None} <= ids


def test_jaccard_keeps_one_row_by_id_and_text(table):
    """An id two texts share loses only the copy; repeated rows and null ids of a group go too; wordless rows stay."""
    a, clean, other = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "x"), (2, clean, "x"), (3, other, "x"), (None, a, "x"), (4, None, "x"), (4, None, "x"), (5, " ", "x"), (None, clean + " end", "x")]
    df = table(rows, "doc_id long, text string, rows string").repartition(3)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted((tuple(r) for r in kept.collect()), key=key) == sorted([(1, a, "x"), (2, clean, "x"), (3, other, "x"), (4, None, "x"), (4, None, "x"), (5, " ", "x")], key=key)
    with pytest.raises(ValueError):
        jaccard.join_documents(df, 70)


def repeated_lines(rows, least):
    """Lines to delete by comparing every position with all earlier ones."""
    seen = sorted({(d is not None, d or 0, t or "") for d, t, *_ in rows})
    seqs = []
    for has, d, t in seen:
        ls = t.split("\n")
        at = [i for i, x in enumerate(ls) if BLANK.search(x.encode())]
        seqs.append(((d if has else None, t), ls, [(i, ls[i].strip(" "), len(BLANK.findall(ls[i].encode()))) for i in at]))
    out = {}
    for n, (name, ls, s) in enumerate(seqs):
        gone = set()
        for p in range(len(s)):
            best = 0
            for m in range(n + 1):
                for q in range(len(seqs[m][2]) if m < n else p):
                    k = 0
                    while p + k < len(s) and q + k < len(seqs[m][2]) and s[p + k][1] == seqs[m][2][q + k][1]:
                        k += 1
                    best = max(best, k)
            if sum(x[2] for x in s[p : p + best]) >= least:
                for k in range(best):
                    stop = s[p + k + 1][0] if p + k + 1 < len(s) else len(ls)
                    gone |= set(range(s[p + k][0], stop))
        out[name] = sorted(gone)
    return out


def test_line_dedup(docs, messy_rows, table):
    runs = [(100, "a b c\nd e f\ng h i\nj", "", ""), (101, "q\na b c\n\nd e f\ng h i\nk", "", ""), (102, "d e f\nd e f\nd e f\nd e f\nd e f", "", "")]
    for rows, least in ((messy_rows, 20), (runs, 6), (runs, 1)):
        want = repeated_lines(rows, least)
        # One unfinished copy of a text under one id is what both sides order by; other ties are only by hash.
        df = table(rows, "doc_id long, text string, lang string, source string")
        got = lines.remove_later_copies(df, least).collect()
        assert len(got) == len(rows)
        by_id = Counter(d for d, t in want)
        for r in got:
            match = [v for (d, t), v in want.items() if d == r.doc_id and by_id[d] == 1]
            if match:
                assert r.removed == match[0], r.doc_id
    out = lines.remove_later_copies(docs)
    assert out.columns == [c for c in docs.columns if c != "removed"] + ["lines", "removed"]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[5] is None and texts[6] == "" and texts[12] == "x y z w v " * 400


def test_line_dedup_empty(no_docs):
    assert lines.remove_later_copies(no_docs).count() == 0


def test_class_model_counts(docs, messy_rows):
    from pyspark.sql import functions as F

    from triagelake.llm.texts import fold

    held = fold(F.col("doc_id"), 7) == 2
    got = classlm.score(docs.withColumn("held_out", held)).collect()
    rows = [(d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, [*words(t), None]) for d, t, *_ in messy_rows]
    count = Counter(w for _, h, ws in rows if not h for w in ws)
    total, kinds = sum(count.values()), len(count)

    def key(d, h, n, known, base):
        return (d is not None, d, h, n, known, round(base, 6))

    want = sorted(key(d, h, len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws)) for d, h, ws in rows)
    assert sorted(key(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)


def test_class_model_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(1)
    c = classlm.CLASSES + 2
    pairs = rng.integers(0, 5, (c, c))
    pairs[:, -1] = 0
    own = pairs[: c - 1].sum(axis=0)
    model = classlm._model(int(own.sum()), c, pairs, rng.integers(0, 3, c))
    # Each class as one word that holds all its tokens, and the new word.
    chance = 10 ** (model.known + np.log10(np.maximum(own, 1)))[:, own > 0]
    assert np.allclose(chance.sum(axis=1) + 10**model.new, 1, atol=1e-9)


def test_class_model_edge_tables(docs, no_docs):
    from pyspark.sql import functions as F

    assert classlm.score(no_docs.withColumn("held_out", F.lit(False))).count() == 0
    rows = classlm.score(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in rows)


def targets(sizes, weights, most):
    """Shares by weight, with what is above the cap shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
        left -= sum(out[s] for s in over)
    return out


def test_mixing(docs, messy_rows):
    sizes = defaultdict(int)
    for _, t, _, s in messy_rows:
        sizes[s] += len(words(t))
    want = targets(sizes, (5, 2, 1), 3)
    got = mixing.mix(docs).collect()
    assert len(got) == len(messy_rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        # The prefix by rank fits; what stays open is less than the shortest way to fill it.
        assert taken[s] <= t + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    assert sum(r.copies * len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mixing_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_pareto_inclusion(spark):
    """Fixed-size samples whose inclusion follows the wanted probabilities."""
    rows = spark.range(40_000).select(F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"), (F.shiftrightunsigned(F.xxhash64("id"), 11) + 0.5).__truediv__(float(2**53)).alias("u"))
    plan = spark.createDataFrame([("s", 40_000, 50_000.0)], "source string, source_size long, target double")
    got = mixing.draw(rows, plan).agg(F.sum("copies"), F.min("copies"), F.max("copies")).first()
    assert abs(got[0] - 50_000) <= 2 and got[1:] == (1, 2)


def test_mixing_inclusion(spark):
    """Over many seeds documents are taken as often as expected, long ones less, and every draw fills its target."""
    sizes = [8] * 60 + [70] * 40 + [300] * 30 + [900] * 10
    total, seeds = sum(sizes), 300
    rows = spark.range(seeds).select(F.col("id").alias("source"), F.posexplode(F.lit(sizes)).alias("doc", "size"))
    rows = rows.withColumn("size", F.col("size").cast("long")).withColumn("u", (F.shiftrightunsigned(F.xxhash64("source", "doc"), 11) + 0.5) / float(2**53))
    plan = spark.range(seeds).select(F.col("id").alias("source"), F.lit(total).cast("long").alias("source_size"), F.lit(1.4 * total).alias("target"))
    drawn = mixing.draw(rows, plan).persist()
    words = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("w")).toPandas().w
    assert (words <= 1.4 * total).all() and words.mean() > 1.38 * total
    per = drawn.groupBy("size").agg(F.avg("copies").alias("copies"), F.first("expected").alias("expected"), F.max("copies").alias("most")).orderBy("size").collect()
    assert [r.expected for r in per] == sorted((r.expected for r in per), reverse=True) and per[0].expected > 1.5 * per[-1].expected
    assert abs(sum(r.expected * n * r["size"] for r, n in zip(per, (60, 40, 30, 10))) - 1.4 * total) < 1e-6 * total
    assert all(abs(r.copies - r.expected) < 0.04 for r in per) and max(r.most for r in per) <= 3
    drawn.unpersist()


def test_mixing_expected_copies(spark, table):
    """Short documents reach the most copies first; the rest take what is left; full and empty sources."""
    classes = table([("a", 1, 10), ("a", 9, 90), ("b", 4, 50), ("c", 1, 0)], "source string, class int, words long")
    plan = table([("a", 100, 270.0), ("b", 50, 150.0), ("c", 0, 0.0)], "source string, source_size long, target double")
    got = {(r.source, r["class"]): r.expected for r in mixing.expected_copies(classes, plan, 3, 0.25).collect()}
    assert got == {("a", 1): 3.0, ("a", 9): pytest.approx(240 / 90), ("b", 4): 3.0, ("c", 1): 0.0}
    even = {r["class"]: r.expected for r in mixing.expected_copies(classes.where("source = 'a'"), plan, 3, 0.0).collect()}
    assert even == {1: pytest.approx(2.7), 9: pytest.approx(2.7)}
