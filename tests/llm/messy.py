import random

import pytest

ALPHABET = "ab bc cd de ef fg gh hi ij jk kl lm mn no op pq qr rs st tu".split()


def prose(rng, n):
    return " ".join(rng.choice(ALPHABET) + rng.choice(ALPHABET) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows and near copies."""
    rng = random.Random(5)
    base = prose(rng, 80)
    passage = "\n".join(prose(rng, 30) for _ in range(3))
    rows = [
        (1, base, "en", "b"),
        (2, base, "en", "a"),
        (3, base.upper(), "fr", None),
        (4, base.replace("abab", "zz") + " extra words here", "en", "a"),
        (5, None, None, None),
        (6, "", "de", "a"),
        (7, " \t\n ", "de", "b"),
        (8, "one two three", "en", "b"),
        (9, "One  two\tthree", "en", "b"),
        (10, passage + "\n" + prose(rng, 40), "en", "c"),
        (11, prose(rng, 40) + "\n\n" + passage + "\n\nend", "en", "c"),
        (12, "x y z w v " * 400, "es", "a"),
        (13, prose(rng, 9000), "en", "c"),
        (None, prose(rng, 50), "en", "b"),
        (14, "1234 !!! 99", "en", "a"),
        (15, "école été où ß ñ é" + " mot" * 7, "fr", "a"),
    ]
    rows += [(2, base, "en", "a"), (2, base, "en", "a"), (15, prose(rng, 20), "fr", "d")]
    rows += [(20 + k, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "fr", "de"]), rng.choice("abc")) for k in range(40)]
    words = base.split()
    for k in range(12):
        near = list(words)
        near[rng.randrange(len(near))] = f"n{k}"
        rows.append((70 + k, " ".join(near), "en", "a"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, table, messy_rows):
    """The messy documents, with columns called as the operators' own."""
    from pyspark.sql import functions as F

    df = table(messy_rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("x")).withColumn("node", F.lit(1)).withColumn("removed", F.lit(0))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
