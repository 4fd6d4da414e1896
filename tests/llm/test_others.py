"""Search, filter, classifier and vector operators."""

import math
import random

import numpy as np
import pytest
from messy import docs, messy_rows, no_docs  # noqa: F401
from pyspark.sql import functions as F

from triagelake.llm import classlm, decontaminate, langid, licenses, toxicity, urls, vectors

ITEMS = [
    (1, "Which planet of the solar system has the largest mass of all? Jupiter is the heaviest by far."),
    (2, "The old mill stood beside the river for more than two hundred years. It burned down in the autumn of that year."),
    (3, None),
    (4, ""),
    (None, "A null item still has words that can be found in some text. Nobody knows its name though."),
]


def test_leaks(spark, table):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice("the of and in a it was mill river years mass planet".split()) for _ in range(n))
    rows = [
        (1, noise(200) + " " + ITEMS[0][1] + " " + noise(300)),
        (2, ITEMS[1][1].upper()),
        (3, noise(500)),
        (4, "Which planet of the solar system has the largest mass of all? " + noise(50)),
        (5, None),
        (6, ""),
        (7, noise(90) + "\n" + ITEMS[1][1].replace(" ", "\n") + " " + ITEMS[0][1]),
        (2, ITEMS[1][1].upper()),
        (None, ITEMS[4][1]),
    ]
    docs = table(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(2)
    bench = table(ITEMS, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.item_id) for r in found)
    assert got == [(False, 0, -1), (True, 1, 1), (True, 2, 2), (True, 2, 2), (True, 7, 1), (True, 7, 2)]
    clean = decontaminate.remove_leaks(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6] and clean.columns == docs.columns
    assert decontaminate.find_leaks(docs.filter("false"), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.filter("false")).count() == 0
    assert decontaminate.remove_leaks(docs, bench.filter("false")).count() == len(rows)


def test_leaks_with_signs_glued_to_items(table):
    items = [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "Who of the four men built the first bridge over the river Elbe? Er."), (4, "Thon heron inesh tion ble swhe rand thly. He walks there.")]
    rows, want = [], []
    for k, (left, right) in enumerate([("***", "***"), ("((", ".&&&"), ("%%%", "$$$"), ("«", "»…"), ("“¡", "”—"), ("。", "！😀")]):
        for i, text in items:
            rows.append((10 * k + i, f"some words before {left}{text}{right} and some words after it"))
            want.append((10 * k + i, i))
    rows += [
        (101, "Which planet of the solar system has the largest mass of all? Saturn, some say, and others name Neptune."),
        (102, "Who of the four men built the first bridge over the river Elbe? Nobody knows."),
        (103, "Thon heron inesh tion ble swhe rand thly! He often walks there."),
    ]
    docs = table(rows, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, table(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [*want, (103, 4)]
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs, table(items, "item_id long, text string")).collect()) == [101, 102]


def test_block_max_search_equals_scoring_all():
    """The passages retrieved are those that scoring every item finds."""
    import pyarrow as pa

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 40)))) for i in range(70)]
    index = decontaminate.build(items)
    texts = []
    for _ in range(200):
        part = rng.choice(items)[1].split()
        cut = rng.randrange(1, len(part) + 1)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)) + part[:cut] + rng.choices(vocabulary, k=rng.randrange(0, 60))))
    got = {(r, i) for r, i, *_ in decontaminate.search(pa.array(texts), index)}
    want = set()
    for r, text in enumerate(texts):
        w = text.split()
        for begin in range(0, len(w), index.stride):
            window = w[begin : begin + 2 * index.stride]
            grams = {tuple(window[k : k + 4]) for k in range(len(window) - 3)}
            hashes = {decontaminate.words_of(pa.array([x])).hash[0] for x in window}
            rows = [t for t, h in enumerate(index.terms) if h in hashes]
            for i, (_, item) in enumerate(items):
                score = sum(index.impacts[k] for t in rows for k in range(index.heads[t], index.heads[t + 1]) if index.items[k] == i)
                own = item.split()
                need = {tuple(own[k : k + 4]) for k in range(len(own) - 3)}
                if score >= decontaminate.RETRIEVE * index.own[i] and len(need & grams) >= decontaminate.OVERLAP * len(need):
                    want.add((r, i))
    assert got == want and len(want) > 20


def test_urls(table):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "block")]
    cases = {
        "http://example.com/en/a": ("example.com", "/en/a", "example.com/en/", "block"),
        "https://WWW.Example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.b.net/es/x#y": ("a.b.net", "/es/x", "net/es/", "block"),
        "http://a.net/es": ("a.net", "/es", None, "allow"),
        "http://notcom/": ("notcom", "/", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://x.com?/en/": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://" + "a." * 300 + "net/es/" + "p" * 5000: ("a." * 300 + "net", "/es/" + "p" * 5000, "net/es/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "old") for i, u in enumerate([*cases, "http://example.com/en/a"])]
    pages = table(rows, "page_id long, url string, rule string")
    lists = table(rules, "host string, path string, verdict string")
    got = urls.judge(pages, lists).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert urls.judge(pages.filter("false"), lists).count() == 0
    assert {r.verdict for r in urls.judge(pages, lists.filter("false"), "block").collect()} == {"block"}


def test_urls_under_rules_of_many_lengths(table):
    """Five thousand rules of as many path lengths: each page finds its own rule, none a shorter one."""
    rules = [("a.com", "/" + "x" * n, "block" if n % 2 else "allow") for n in range(5000)]
    pages = [(n, f"http://a.com/{'x' * n}") for n in (0, 1, 2, 500, 4094, 4095, 4096, 4097, 4998, 4999, 6000)]
    got = urls.judge(table(pages, "page_id long, url string"), table(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: len(r.rule) - 6 for r in got} == {n: min(n, 4999) for n, _ in pages}
    assert all((r.verdict == "block") == (min(r.page_id, 4999) % 2 == 1) for r in got)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    field = urls.bloom(keys)
    own = np.array([r.key for r in keys.collect()], np.int64)
    other = np.array([r.key for r in spark.range(20_000, 40_000).select(F.xxhash64("id").alias("key")).collect()], np.int64)
    assert urls.maybe(own, field).all() and urls.maybe(other, field).mean() < 0.02


def test_vectors(table):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = []
    for k, v in enumerate(base):
        rows += [(10 * k + j, (v + 0.12 * j * rng.standard_normal(16)).tolist(), k % 3) for j in range(3)]
    rows += [(900 + j, base[0].tolist(), 0) for j in range(4)] + [(900, base[0].tolist(), 0)]
    rows += [(910, (2 * base[0]).tolist(), 0), (911, base[0].tolist(), 1), (912, base[0].tolist(), None), (913, None, 0), (914, [], 0), (915, [0.0] * 16, 0)]
    rows += [(916, [float("nan")] * 16, 0), (917, [*base[0][:15].tolist(), None], 0), (918, base[0][:15].tolist(), 0), (919, [float("inf")] * 16, 0)]
    df = table(rows, "vec_id long, embedding array<double>, label int").withColumn("name", F.lit(1)).withColumn("copies", F.lit(1)).repartition(3)
    good = [(i, np.array(e), lab) for i, e, lab in rows if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links, group = {}, list(range(len(good)))
    for a, (i, x, la) in enumerate(good):
        for b, (j, y, lb) in enumerate(good):
            if a != b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] = links.get(a, 0) + 1
                ga, gb = group[a], group[b]
                group = [min(ga, gb) if g in (ga, gb) else g for g in group]
    low = {g: min(good[a][0] for a in range(len(good)) if group[a] == g) for g in set(group)}
    want = sorted([(good[a][0], links.get(a, 0), low[group[a]]) for a in range(len(good))] + [(i, 0, i) for i in (912, 913, 914, 915, 916, 917, 919)])
    got = vectors.link_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.link_vectors(df.filter("false")).count() == 0


def test_vectors_of_huge_and_tiny_values(table):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1e-320, 1e-320]), (5, [1e300, -1e300]), (6, [1.7e308, 1.7e308]), (7, [0.0, 0.0]), (8, [1e308, float("inf")])]
    df = table([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.link_vectors(df).collect()}
    assert got == {i: (4, 1) for i in (1, 2, 3, 4, 6)} | {i: (0, i) for i in (5, 7, 8)}


def test_code_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + 0.05 * rng.standard_normal((400, 64))
    y /= np.linalg.norm(y, axis=1)[:, None]
    turn = vectors.rotations(64)[:64]
    sign = np.where(x @ turn.T > 0, 1, -1) / 8
    factor = (sign * (x @ turn.T)).sum(axis=1)
    error = (sign * (y @ turn.T)).sum(axis=1) / factor - (x * y).sum(axis=1)
    assert abs(error.mean()) < 0.01
    bound = vectors.WIDTH * np.sqrt((1 - factor**2) / (factor**2 * 63))
    assert (np.abs(error) <= bound).all()


def test_languages(spark, docs, no_docs):
    from triagelake.llm.texts import fold

    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(data.filter(fold(F.col("doc_id"), 3) != 1))
    got = langid.predict(data, model).join(data.select("doc_id", "lang"), "doc_id").filter(fold(F.col("doc_id"), 3) == 1)
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    mess = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(mess[i].lang_pred == "und" and mess[i].score == 0 for i in (5, 6, 7, 14)) and mess[12].lang_pred != "und"
    assert langid.predict(no_docs, model).count() == 0
    assert langid.learn(no_docs) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    single = langid.learn(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs.filter("doc_id = 1"), single).collect()} == {"en"}


def test_every_language_is_learned_whatever_its_copies(spark, table):
    words = {"en": "the house of and river", "fr": "la maison dans une rue", "de": "das haus und der fluss"}
    rows = [(k, f"{words['en']} {k}", "en") for k in range(300)] + [(400 + k, f"{words['fr']} {k}", "fr") for k in range(300)]
    copies = table([(1000, f"{words['de']} eins", "de"), (1001, f"{words['de']} zwei", "de")], "doc_id long, text string, lang string")
    docs = table(rows, "doc_id long, text string, lang string").union(copies.crossJoin(spark.range(2000)).drop("id"))
    for max_rows in (6, 30, 4000):
        model = langid.learn(docs, max_rows)
        assert sorted(code for codes in model.families.values() for code in codes) == ["de", "en", "fr"]
    assert {r.lang_pred for r in langid.predict(copies, model).collect()} == {"de"}
    # One text under two languages teaches both.
    both = table([(1, "abc def", "en"), (2, "abc def", "fr"), (3, "ghi jkl", "fr")], "doc_id long, text string, lang string")
    assert sorted(code for codes in langid.learn(both).families.values() for code in codes) == ["en", "fr"]


@pytest.fixture(scope="module")
def labelled(table):
    rng = random.Random(7)
    plain = "the house river tree stands walks green small often under bridge".split()
    rows, marks = [], []
    for i in range(400):
        text = rng.choices(plain, k=30) + ([rng.choice(["grobax", "grobix", "vilmet"])] if i % 4 == 0 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        marks.append((i, None, 1 if i % 4 == 0 else 0))
    return table(rows, "doc_id long, text string"), table([*marks, (3, None, None), (None, None, 1), (9999, None, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_insults(labelled, docs, no_docs):
    texts, labels = labelled
    grammar = toxicity.learn(texts, labels.filter("doc_id % 5 <> 0"))
    score = grammar.compiled().score
    assert score("under the grobox tree") > 0.5 > score("under the green tree") == score("") == score(None)
    got = toxicity.score(texts, grammar).join(labels, "doc_id").filter("doc_id % 5 = 0 and toxic is not null")
    assert got.filter("(score >= 0.5) = (toxic = 1)").count() == got.count()
    assert toxicity.score(docs, grammar).count() == docs.count() and toxicity.score(no_docs, grammar).count() == 0
    kept = toxicity.reject(docs, grammar)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_toxicity_paths(docs, labelled):
    grammar = toxicity.learn(docs, labelled[1].filter("false"))
    find = grammar.compiled().matches
    path = lambda t: [m[2] for m in find(t)]
    assert path("You are an idiot.") == ["targeted"]
    assert path("What an idiot. He is kind.") == ["plain"]
    assert path("You are not an idiot!") == ["negated"]
    assert path("The man said you idiot") == ["reported"]
    assert path("I will kill you now") == ["threat"]
    assert path("kill the process") == [] and path("idiotic") == [] and path("a pidiot") == []
    score = grammar.compiled().score
    assert score("you idiot") > 0.5 > score("you are not an idiot") > score("kind words")
    (start, end, *_), = find("Oh, you IDIOT!")
    assert "Oh, you IDIOT!"[start:end] == "IDIOT"
    assert 0 <= score("idiot " * 5000) <= 1


def test_licenses(table):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta license the under".split()) for _ in range(n))
    long = licenses.TEMPLATES[5][1]
    edited = long.replace("can redistribute", "may also redistribute").replace("either ", "")
    rows = [
        (1, filler(30) + "\nReleased under the MIT License.\n" + filler(9)),
        (2, "é " + edited + " " + filler(2000)),
        (3, filler(300)),
        (4, None),
        (5, ""),
        (6, "LICENSED UNDER CC BY-NC 4.0 and licensed   under cc by nc 4.0!"),
        (7, "license version"),
        (1, "Released under the MIT License."),
        (None, "Released under the MIT License"),
    ]
    docs = table(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    got = licenses.find_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, "GPL-3.0"), (6, "CC-BY-NC-4.0"), (6, "CC-BY-NC-4.0")]
    by_id = {(r.doc_id, r.start): r for r in got}
    text = dict(rows[:7])
    r = next(r for r in got if r.doc_id == 2)
    assert 0.9 < r.coverage < 1 and text[2][r.start : r.end].startswith("This program") and text[2][r.start : r.end].endswith("any later version")
    assert len(by_id) == 6
    assert licenses.find_licenses(docs.filter("false")).count() == 0


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        template = [rng.randrange(6) for _ in range(rng.randrange(3, 9))]
        text = [rng.randrange(6) for _ in range(rng.randrange(0, 9))]
        best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
        for j, t in enumerate(template):
            for i, x in enumerate(text):
                best[j + 1][i + 1] = best[j][i] + 1 if t == x else max(best[j][i + 1], best[j + 1][i])
        # Short sequences lie inside the band.
        before = [-1] * licenses.BAND
        assert licenses.align(np.array(before + text), np.array(template))[0] == best[-1][-1]


def test_rare_words_are_placed_from_all_their_contexts():
    """Second in each slice, first over all: the gains of all contexts are summed, not the winners of slices."""
    c = classlm.CLASSES + 1
    rng = np.random.default_rng(5)
    m = rng.integers(1, 50, (c, c))
    follow, precede = classlm._logs(m)
    word, context, times = rng.integers(0, 300, 5000), rng.integers(0, 2 * c, 5000).astype(np.uint8), rng.integers(1, 9, 5000)
    got = classlm._placed(word, context, times, 301, follow, precede, 7)
    want = np.zeros((300, classlm.CLASSES))
    for w, k, n in zip(word, context, times):
        want[w] += n * (precede[k, : classlm.CLASSES] if k < c else follow[: classlm.CLASSES, k - c])
    assert (got[:300] == want.argmax(axis=1)).all() and got[300] == 7


def test_scores_do_not_depend_on_slices(spark, table):
    rng = random.Random(6)
    frequent = [f"f{i}" for i in range(4200)]
    rows = [(i, i % 7 == 2, " ".join(x for _ in range(60) for x in (rng.choice(frequent), f"r{rng.randrange(900)}" if rng.random() < 0.03 else "and"))) for i in range(1500)]
    docs = table(rows, "doc_id long, held_out boolean, text string")
    first = {r.doc_id: r.score for r in classlm.score(docs.coalesce(1)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = {r.doc_id: r.score for r in classlm.score(docs.repartition(3), 1 << 16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(first) == 1500 and all(abs(first[i] - again[i]) < 1e-6 for i in first)
