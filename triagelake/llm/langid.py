"""Language identification: the family first, then one-versus-one linear support vector machines in it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import pack, small, text_bytes, unpack

# Families of ISO 639-1 codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi bn ur mr pa gu ne".split(),
    "sinitic": "zh yue wuu".split(),
    "semitic": "ar he am mt".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy br gd".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

#: Hashed features of a text: byte sequences of these lengths, lowered in A-Z.
DIM = 4096
GRAMS = (2, 3, 4)
#: Labelled rows the classifiers are fitted on at most, shared evenly by the languages.
MAX_ROWS = 4000

_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """A unit vector for each text: square roots of the counts of its hashed byte sequences."""
    raw, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    step = 1 << 20
    for i in range(len(out)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        counts = np.zeros(DIM)
        for at in range(lo, hi, step):
            part = _LOWER[raw[at : min(at + step + max(GRAMS) - 1, hi)]].astype(np.uint32)
            end = min(at + step, hi) - at
            for n in GRAMS:
                m = min(len(part) - n + 1, end)
                if m <= 0:
                    continue
                h = np.full(m, n, np.uint32)
                for k in range(n):
                    h *= np.uint32(0x01000193)
                    h ^= part[k : k + m]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                counts += np.bincount((h >> np.uint32(20)), minlength=DIM)
        norm = np.sqrt(counts.sum())
        if norm:
            out[i] = np.sqrt(counts) / norm
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights and intercept of a linear support vector machine (squared hinge) for y of -1 and 1, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # Both sides weigh alike whatever their numbers.
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost
    rate = 1.0 / (1.0 / len(x) + 4 * weight.sum())
    w = v = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / len(x) - 2 * x.T @ (weight * slack * y)
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """``top``: one machine per family against the others; ``pairs``: one per pair of languages of a family."""

    families: dict[str, list[str]]
    top: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        margin = np.stack([x @ self.top[f][:-1] + self.top[f][-1] for f in names], axis=1) if len(names) > 1 else np.zeros((len(x), 1))
        best = margin.argmax(axis=1)
        odds = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
        sure = 1 / odds.sum(axis=1)
        lang = np.empty(len(x), object)
        for k, family in enumerate(names):
            rows = np.flatnonzero(best == k)
            langs = self.families[family]
            votes = np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                w = self.pairs[langs[a], langs[b]]
                win = 1 / (1 + np.exp(-3 * (x[rows] @ w[:-1] + w[-1])))
                votes[:, a] += win
                votes[:, b] += 1 - win
            if len(langs) > 1:
                sure[rows] *= votes.max(axis=1) / (len(langs) - 1)
            lang[rows] = np.array(langs, object)[votes.argmax(axis=1)]
        return list(lang), np.clip(sure, 0, 1)


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    langs = sorted(set(lang))
    families: dict[str, list[str]] = {}
    for code in langs:
        families.setdefault(family_of(code), []).append(code)
    family = np.array([family_of(code) for code in lang])
    top = {f: svm(x, np.where(family == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
    pairs = {}
    for codes in families.values():
        for a, b in combinations(codes, 2):
            rows = (lang == a) | (lang == b)
            pairs[a, b] = svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))
    return Model(families, top, pairs)


def _featured(batches):
    for b in batches:
        x = features(b.column(1))
        yield pa.record_batch([b.column(0), pa.array([pack(r.astype(np.float16)) for r in x], pa.binary())], names=["lang", "x"])


def learn(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on a bounded sample of rows with ``lang`` and a text with letters; None without any.

    Every language gives at most ``max_rows`` over the number of languages (two at least), those of
    the smallest hash among its distinct texts; however often its texts are repeated, a language is in the model.
    """
    place = F.shiftrightunsigned("h", 11)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    texts = known.select("lang", "h").distinct()
    counts = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max(2, max_rows // len(counts))
    # More than the share lie below this reach, by far, so that few hashes are sorted; their share-th is the last to take.
    reach = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, (2 * share + 64) / n))])
    low = texts.filter(place / float(2**53) < F.element_at(reach, F.col("lang"))).groupBy("lang").agg(F.sort_array(F.collect_set(place)).alias("low"))
    last = {r[0]: r[1] for r in low.select("lang", F.element_at("low", F.least(F.size("low"), F.lit(share)))).collect()}
    cut = F.create_map(*[F.lit(v) for item in sorted(last.items()) for v in item])
    chosen = known.filter(place <= F.element_at(cut, F.col("lang"))).dropDuplicates(["lang", "h"])
    rows = chosen.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    rows.sort()
    return fit(np.stack([unpack(r.x, np.float16) for r in rows]).astype(np.float32), np.array([r.lang for r in rows]))


def _predicted(batches, model: Model | None):
    for b in small(batches, 1):
        texts = b.column(1)
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
        lang, sure = np.array(["und"] * b.num_rows, object), np.zeros(b.num_rows)
        at = np.flatnonzero(lettered)
        if model is not None:
            for s in range(0, len(at), 256):
                rows = at[s : s + 256]
                names, p = model.predict(features(texts.take(pa.array(rows))))
                lang[rows], sure[rows] = names, p
        yield pa.record_batch([b.column(0), pa.array(list(lang), pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score``, a row per row; ``und`` with score 0 for null texts and those without a letter, or without a model."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_predicted, model=model), "doc_id long, lang_pred string, score double")
