"""Class-based bigram scoring of texts (Brown classes by the exchange algorithm).

A word belongs to one class; the probability of a word after another is that of its class
after the other's class, times that of the word in its class. Classes of the ``TOP`` most frequent
training words are found by exchange: every word moves to the class under which its neighbours on both
sides are likeliest, round by round, each round a Spark job over slices of the bigram table (parallel
exchange: all words of a round see the classes of the round before). Every other training word is placed
by the same criterion from all its occurrences.

Texts are tokenised once, into rows of many documents: the distinct words of the row by
partition, and the documents as numbers of those words. Counts and classes are kept by
partition of the words and answered to each row, so the vocabulary is never in one place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import U64, deal, pack, small, unpack, words_of
from triagelake.llm.store import materialize, shuffle_parts

#: Words whose classes are exchanged in rounds; bounds what a round sends and gets back.
TOP = 4096
CLASSES = 63
ROUNDS = 6
#: Bytes of text of an encoded row.
SLICE = 12 << 20
#: The end of a text: a token of its own with a class of its own, also what stands before a text.
END = U64(0xE0D0E0D0E0D0E0D1)
#: Weight of the class frequencies in the class transitions.
ALPHA = 1.0


def _encode(batches, parts: int, most: int):
    """doc_id, held, text -> one row per slice: documents as word numbers, words with their training counts."""
    part, serial = TaskContext.get().partitionId(), 0
    for b in small(batches, 2, most):
        words = words_of(b.column(2))
        n = np.diff(words.bounds) + 1
        tokens = np.insert(words.hash, words.bounds[1:], END)
        held = np.array(b.column(1).to_pylist(), bool)
        distinct, number, total = np.unique(tokens, return_inverse=True, return_counts=True)
        train = np.bincount(number[np.repeat(~held, n)], minlength=len(distinct))
        # Words by partition; the most frequent have the smallest numbers in the codes, which packs best.
        order = np.argsort(distinct % U64(parts), kind="stable")
        by_use = np.argsort(-total[order], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order[by_use]] = np.arange(len(order))
        yield pa.record_batch(
            [
                pa.array([part << 32 | serial], pa.int64()),
                pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([pack(held)], pa.binary()),
                pa.array([pack(n.astype(np.uint32))], pa.binary()),
                pa.array([pack(rank[number].astype(np.uint32))], pa.binary()),
                pa.array([pack(by_use.astype(np.uint32))], pa.binary()),
                pa.array([distinct[order].tobytes()], pa.binary()),
                pa.array([pack(train[order].astype(np.uint32))], pa.binary()),
            ],
            names=["g", "ids", "held", "lens", "codes", "by_use", "words", "train"],
        )
        serial += 1


_TEXTS = "g long, ids array<long>, held binary, lens binary, codes binary, by_use binary, words binary, train binary"


@dataclass
class Row:
    """A row of encoded documents."""

    words: np.ndarray
    train: np.ndarray
    held: np.ndarray
    lens: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Row:
        by_use = unpack(r["by_use"], np.uint32)
        return cls(np.frombuffer(r["words"], U64), unpack(r["train"], np.uint32), unpack(r["held"], bool), unpack(r["lens"], np.uint32).astype(np.int64), by_use[unpack(r["codes"], np.uint32)])

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """For each token the value of the one before it; ``start`` at the beginning of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[np.cumsum(self.lens) - self.lens] = start
        return out

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lens)


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


_BIN = pa.binary()


def _split_counts(batches, parts: int):
    for r in _rows(batches):
        words, train = np.frombuffer(r["words"], U64), unpack(r["train"], np.uint32)
        rows = [(p, words[at].tobytes(), pack(train[at])) for p, at in deal(words % U64(parts), parts)]
        yield _table(rows, ["part", "words", "train"], [pa.int32(), _BIN, _BIN])


def _sum_by(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, number = np.unique(words, return_inverse=True)
    return distinct, np.bincount(number, counts, minlength=len(distinct)).astype(np.int64)


def _counted(table: pa.Table) -> pa.Table:
    """All counts of a partition -> number of words and tokens, and its most frequent words."""
    words = np.concatenate([np.frombuffer(x, U64) for x in table.column("words").to_pylist()])
    counts = np.concatenate([unpack(x, np.uint32) for x in table.column("train").to_pylist()])
    words, counts = _sum_by(words, counts)
    words, counts = words[counts > 0], counts[counts > 0]
    top = np.argsort(-counts, kind="stable")[:TOP]
    return pa.table({"v": pa.array([len(words)], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64()), "top": pa.array([words[top].tobytes()], _BIN), "count": pa.array([pack(counts[top])], _BIN)})


def _numbers(words: np.ndarray, top: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Number of each word among the frequent ones (``top`` sorted, ``order`` their numbers); -1 for others."""
    at = np.searchsorted(top, words)
    at[at == len(top)] = 0
    return np.where(top[at] == words, order[at], -1)


def _bigrams(batches, top: np.ndarray, order: np.ndarray, slices: int, size: int):
    """Counts of neighbouring frequent words, dealt by the word: kind 0 by the first (its followers), 1 by the second."""
    for raw in _rows(batches):
        r = Row.of(raw)
        token = _numbers(r.words, top, order)[r.tokens]
        left = r.before(token, order[np.searchsorted(top, END)])
        ok = (token >= 0) & (left >= 0) & r.training()
        pair, count = np.unique(left[ok] * size + token[ok], return_counts=True)
        rows = []
        for kind, key in ((0, pair // size), (1, pair % size)):
            rows += [(p, kind, pack(pair[at]), pack(count[at].astype(np.uint32))) for p, at in deal(key % slices, slices)]
        yield _table(rows, ["part", "kind", "pairs", "counts"], [pa.int32(), pa.int32(), _BIN, _BIN])


def _adjacent(table: pa.Table) -> pa.Table:
    out = []
    part = table.column("part")[0].as_py()
    kinds = np.array(table.column("kind").to_pylist())
    for kind in (0, 1):
        at = np.flatnonzero(kinds == kind)
        pairs = [unpack(table.column("pairs")[int(i)].as_py(), np.int64) for i in at]
        counts = [unpack(table.column("counts")[int(i)].as_py(), np.uint32) for i in at]
        pair, count = _sum_by(np.concatenate(pairs), np.concatenate(counts)) if pairs else (np.zeros(0, np.int64),) * 2
        out.append((part, kind, pack(pair), pack(count)))
    return pa.Table.from_batches([_table(out, ["part", "kind", "pairs", "counts"], [pa.int32(), pa.int32(), _BIN, _BIN])])


def _transitions(batches, classes: np.ndarray, size: int):
    """Class bigrams of the words that have a class, from the table of followers."""
    c = CLASSES + 1
    out = np.zeros((c, c), np.int64)
    for r in _rows(batches):
        if r["kind"] == 0:
            pair, count = unpack(r["pairs"], np.int64), unpack(r["counts"], np.int64)
            a, b = classes[pair // size], classes[pair % size]
            ok = (a >= 0) & (b >= 0)
            np.add.at(out, (a[ok], b[ok]), count[ok])
    yield _table([(out.tobytes(),)], ["m"], [_BIN])


def _moves(batches, classes: np.ndarray, size: int, follow: np.ndarray, precede: np.ndarray):
    """The best class of each word of a slice, by its followers and predecessors."""
    c = CLASSES + 1
    score: dict[int, tuple] = {}
    for r in _rows(batches):
        pair, count = unpack(r["pairs"], np.int64), unpack(r["counts"], np.int64)
        own, other = (pair // size, pair % size) if r["kind"] == 0 else (pair % size, pair // size)
        ok = classes[other] >= 0
        words, number = np.unique(own[ok], return_inverse=True)
        seen = np.bincount(number * c + classes[other[ok]], count[ok], minlength=len(words) * c).reshape(-1, c)
        gain = seen @ (follow.T if r["kind"] == 0 else precede)
        score.setdefault(r["part"], []).append((words, gain))
    for parts in score.values():
        words = np.unique(np.concatenate([w for w, _ in parts]))
        total = np.zeros((len(words), c))
        for w, g in parts:
            total[np.searchsorted(words, w)] += g
        best = total[:, :CLASSES].argmax(axis=1)
        yield _table([(pack(words), pack(best))], ["words", "classes"], [_BIN, _BIN])


def _logs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a class for a following and for a preceding class: log P(next | c), and log P(c | before) - log N(c)."""
    own = m.sum(axis=0)
    follow = np.log((m + ALPHA * (own + 1) / (own.sum() + len(m))) / (m.sum(axis=1, keepdims=True) + ALPHA))
    return follow, follow - np.log(own + 1.0)


def exchange(pairs: DataFrame, size: int, end: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the ``size`` frequent words (numbered by falling frequency) and the class bigrams.

    The most frequent words begin as a class each, all others without one. In every round all words move;
    in every second round only those of even number, so that pairs of words cannot swap for ever.
    """
    classes = np.full(size, -1)
    free = [i for i in range(size) if i != end][:CLASSES]
    classes[free] = np.arange(len(free))
    classes[end] = CLASSES

    def counted() -> np.ndarray:
        rows = pairs.mapInArrow(partial(_transitions, classes=classes, size=size), "m binary").collect()
        return sum((np.frombuffer(r.m, np.int64) for r in rows), np.zeros((CLASSES + 1) ** 2, np.int64)).reshape(CLASSES + 1, -1)

    m = counted()
    for k in range(rounds):
        follow, precede = _logs(m)
        new = classes.copy()
        for r in pairs.mapInArrow(partial(_moves, classes=classes, size=size, follow=follow, precede=precede), "words binary, classes binary").collect():
            new[unpack(r.words, np.int64)] = unpack(r.classes, np.int64)
        new[end] = CLASSES
        if k % 2:
            stay = (np.arange(size) % 2 == 1) & (classes >= 0)
            new[stay] = classes[stay]
        if np.array_equal(new, classes):
            break
        classes = new
        m = counted()
    return classes, m


def _contexts(batches, top, order, classes, parts: int):
    """For every word of a row: training count, its class if it is frequent, else how often each class stands before and after it there."""
    c = CLASSES + 1
    for raw in _rows(batches):
        r = Row.of(raw)
        number = _numbers(r.words, top, order)
        of_word = np.where(number >= 0, classes[number], -1)
        token = of_word[r.tokens]
        left = r.before(token, CLASSES)
        right = np.append(token[1:], -1)
        rare = (token < 0) & r.training()
        before, after = rare & (left >= 0), rare & (right >= 0)
        word = r.tokens.astype(np.int64) * 2 * c
        key, count = np.unique(np.concatenate([word[before] + left[before], word[after] + c + right[after]]), return_counts=True)
        near = np.bincount(key // (2 * c), minlength=len(r.words))
        # Words of a partition stand together, and so do their contexts.
        bound = np.concatenate([[0], np.cumsum(near)])
        own = np.where(of_word < 0, 255, of_word).astype(np.uint8)
        rows = []
        for p, at in deal(r.words % U64(parts), parts):
            of = slice(bound[at[0]], bound[at[-1] + 1])
            rows.append((p, raw["g"], r.words[at].tobytes(), pack(r.train[at]), pack(own[at]), pack(near[at].astype(np.uint32)), pack((key[of] % (2 * c)).astype(np.uint8)), pack(count[of].astype(np.uint32))))
        yield _table(rows, ["part", "g", "words", "train", "own", "near", "context", "times"], [pa.int32(), pa.int64(), *[_BIN] * 6])


_CONTEXTS = "part int, g long, words binary, train binary, own binary, near binary, context binary, times binary"
#: Words whose gains are computed at a time.
GAINS = 1 << 14


def _placed(word: np.ndarray, context: np.ndarray, times: np.ndarray, n: int, follow: np.ndarray, precede: np.ndarray, default: int) -> np.ndarray:
    """The class of each of ``n`` words under which all its contexts together are likeliest; ``default`` without any."""
    c = CLASSES + 1
    best = np.full(n, default)
    order = np.argsort(word, kind="stable")
    word, context, times = word[order], context[order], times[order]
    for lo in range(0, n, GAINS):
        hi = min(lo + GAINS, n)
        at = slice(*np.searchsorted(word, [lo, hi]))
        seen = np.bincount((word[at] - lo) * 2 * c + context[at], times[at], minlength=(hi - lo) * 2 * c).reshape(-1, 2 * c)
        # Rounded, so that the order of the sums does not break ties.
        gain = np.round(seen[:, :c] @ precede[:, :CLASSES] + seen[:, c:] @ follow.T[:, :CLASSES], 6)
        best[lo:hi] = np.where(seen.any(axis=1), gain.argmax(axis=1), default)
    return best


def _answers(default: int, follow: np.ndarray, precede: np.ndarray):
    """Counts and classes of a partition's words, answered to each row that has them."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        lists = [np.frombuffer(x, U64) for x in table.column("words").to_pylist()]
        words = np.concatenate(lists)
        names = (("train", np.uint32), ("own", np.uint8), ("near", np.uint32), ("context", np.uint8), ("times", np.uint32))
        train, own, near, context, times = (np.concatenate([unpack(x.as_py(), t) for x in table.column(n)]) for n, t in names)
        distinct, number = np.unique(words, return_inverse=True)
        count = np.bincount(number, train, minlength=len(distinct)).astype(np.int64)
        best = _placed(np.repeat(number, near), context, times, len(distinct), follow, precede, default)
        # A frequent word has the same class in every row.
        best[number[own < 255]] = own[own < 255]
        cuts = np.cumsum([0] + [len(x) for x in lists])
        rows = [(g, part, pack(count[number[a:b]]), pack(best[number[a:b]].astype(np.uint8))) for g, a, b in zip(table.column("g").to_pylist(), cuts[:-1], cuts[1:])]
        return pa.Table.from_batches([_table(rows, ["g", "part", "count", "class"], [pa.int64(), pa.int32(), _BIN, _BIN])])

    return run


def _joined(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """A row of documents with the counts and classes of its words, in the order of the row's words."""
    order = np.argsort(answers.column("part").to_numpy())
    count = np.concatenate([unpack(answers.column("count")[int(i)].as_py(), np.int64) for i in order])
    cls = np.concatenate([unpack(answers.column("class")[int(i)].as_py(), np.uint8) for i in order])
    by_use = unpack(texts.column("by_use")[0].as_py(), np.uint32)
    return pa.table(
        {
            "g": texts.column("g"), "ids": texts.column("ids"), "held": texts.column("held"), "lens": texts.column("lens"), "codes": texts.column("codes"),
            "count": pa.array([pack(count[by_use])], _BIN), "class": pa.array([pack(cls[by_use])], _BIN),
        }
    )


_CODED = "g long, ids array<long>, held binary, lens binary, codes binary, count binary, class binary"


def _coded(r: dict) -> tuple[Row, np.ndarray, np.ndarray]:
    row = Row(None, None, unpack(r["held"], bool), unpack(r["lens"], np.uint32).astype(np.int64), unpack(r["codes"], np.uint32))
    return row, unpack(r["count"], np.int64)[row.tokens], unpack(r["class"], np.uint8)[row.tokens].astype(np.int64)


#: Context of a word after one that training never saw.
_NEW = CLASSES + 1


def _statistics(batches):
    """Class bigrams of all training tokens; words seen once also stand for words never seen."""
    c = CLASSES + 2
    pairs, once = np.zeros(c * c, np.int64), np.zeros(c, np.int64)
    for raw in _rows(batches):
        row, count, cls = _coded(raw)
        left, train = row.before(cls, CLASSES), row.training()
        pairs += np.bincount(left[train] * c + cls[train], minlength=c * c)
        after_new = (row.before(count, 0) == 1) & train
        pairs += np.bincount(_NEW * c + cls[after_new], minlength=c * c)
        single = (count == 1) & train
        once += np.bincount(left[single], minlength=c)
        once[_NEW] += int((single & after_new).sum())
    yield _table([(pairs.tobytes(), once.tobytes())], ["pairs", "once"], [_BIN, _BIN])


@dataclass
class Model:
    """log10 of P(class | class before) / N(class) for known words, and of a new word after each class."""

    tokens: int
    words: int
    known: np.ndarray
    new: np.ndarray


def _model(tokens: int, words: int, pairs: np.ndarray, once: np.ndarray) -> Model:
    c = CLASSES + 2
    own = pairs[: CLASSES + 1].sum(axis=0).astype(float)
    before = pairs.sum(axis=1, keepdims=True).astype(float)
    share = (pairs + ALPHA * own / max(own.sum(), 1)) / (before + ALPHA)
    fresh = (once[:, None] + 0.5) / (before + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        known = np.log10(share * (1 - fresh) / own)
    return Model(tokens, words, np.where(np.isfinite(known), known, 0.0).reshape(c, c), np.log10(fresh[:, 0]))


def _scored(batches, model: Model):
    floor = np.log10(model.tokens + model.words + 1.0)
    for raw in _rows(batches):
        row, count, cls = _coded(raw)
        seen = count > 0
        left = row.before(np.where(seen, cls, _NEW), CLASSES)
        logs = np.where(seen, model.known[left, cls] + np.log10(np.maximum(count, 1)), model.new[left])
        head = np.cumsum(row.lens) - row.lens
        yield pa.record_batch(
            [
                pa.array(raw["ids"], pa.int64()),
                pa.array(row.held),
                pa.array(row.lens),
                pa.array(np.add.reduceat(seen.astype(np.int64), head)),
                pa.array(np.full(len(head), model.tokens, np.int64)),
                pa.array(np.add.reduceat(np.log10(count + 1.0) - floor, head)),
                pa.array(np.add.reduceat(logs, head)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for rows of ``doc_id, held_out, text``.

    The model learns from the rows that are not held out. ``score`` is the log10 probability of
    the text's words and its end under the class model, ``base_score`` under the smoothed word frequencies; in both a word never
    seen in training is one event ("a new word"). Its probability after a class is the share of words seen
    once there. A null text is empty: only its end is scored. Repeated rows count as often as they occur. Without training rows
    every word is new. Other columns are not read.
    The scores do not depend on ``slice_bytes`` or the number of partitions.
    """
    parts = shuffle_parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    texts = materialize(rows.mapInArrow(partial(_encode, parts=parts, most=slice_bytes), _TEXTS), "tokens")
    split = texts.select("words", "train").mapInArrow(partial(_split_counts, parts=parts), "part int, words binary, train binary")
    counted = split.groupBy("part").applyInArrow(_counted, "v long, n long, top binary, count binary").collect()
    tokens, words = sum(r.n for r in counted), sum(r.v for r in counted)
    top = np.concatenate([np.frombuffer(r.top, U64) for r in counted] + [np.zeros(0, U64)])
    most = np.concatenate([unpack(r["count"], np.int64) for r in counted] + [np.zeros(0, np.int64)])
    chosen = np.lexsort((top, -most))[:TOP]
    top = top[chosen] if END in top[chosen] else np.append(top[chosen], END)
    order = np.argsort(top)
    size, end = len(top), int(np.flatnonzero(top == END)[0])
    lookup = {"top": top[order], "order": order}
    slices = min(parts, 64)
    pairs = texts.mapInArrow(partial(_bigrams, slices=slices, size=size, **lookup), "part int, kind int, pairs binary, counts binary")
    pairs = materialize(pairs.groupBy("part").applyInArrow(_adjacent, "part int, kind int, pairs binary, counts binary"), "bigrams")
    # Both kinds of a slice in one task.
    pairs = pairs.repartition(slices, "part")
    classes, m = exchange(pairs, size, end)
    follow, precede = _logs(m)
    # A word without a frequent neighbour goes where most tokens of the others are.
    default = int(m[:, :CLASSES].sum(axis=0).argmax())
    contexts = texts.mapInArrow(partial(_contexts, classes=np.append(classes, -1), parts=parts, **lookup), _CONTEXTS)
    answers = contexts.groupBy("part").applyInArrow(_answers(default, follow, precede), "g long, part int, count binary, class binary")
    coded = texts.drop("words", "train").groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_joined, _CODED)
    coded = materialize(coded, "coded")
    stats = coded.mapInArrow(_statistics, "pairs binary, once binary").collect()
    c = CLASSES + 2
    total = sum((np.frombuffer(r.pairs, np.int64) for r in stats), np.zeros(c * c, np.int64)).reshape(c, c)
    once = sum((np.frombuffer(r.once, np.int64) for r in stats), np.zeros(c, np.int64))
    return coded.mapInArrow(partial(_scored, model=_model(tokens, words, total, once)), _SCORES)
