"""Tokens of two tokenizers over the same bytes: overlaps, equal ends, groups, and how often ids end together.

Each text is encoded by both sides. ``pandas.merge_asof``, keyed by document, finds for the
start of every token the token of the other side that covers it; both directions together are
all overlaps. Overlapping tokens that end together are linked, and their ends cut both
sequences into groups of equal bytes.

Words of a batch are encoded once each. A text is cut before a space that follows a plain
character: the byte-level side starts a new piece there whatever the context, and no piece of
the other side holds a space after another character (this is checked when it is loaded).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import small, text_bytes
from triagelake.llm.store import materialize

#: Bytes of text aligned at a time; bounds the memory of a step, not the length of a text.
SLICE = 4 << 20

#: Characters after which a space does not begin a word of its own: blanks and controls of any kind, and the piece sign.
_BLANKS = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u206f\\u2581\\u3000\\ufeff"
_CUT = re.compile(f"(?<=[^{_BLANKS}]) (?=.)", re.S)
#: Texts in which some space follows such a character, begins or ends the text.
_AWKWARD = "^ | $|[" + re.sub(r"\\u(....)", r"\\x{\1}", _BLANKS) + "] "
_OPEN_END = "[" + re.sub(r"\\u(....)", r"\\x{\1}", _BLANKS) + "]$"


#: The pieces a byte-level BPE of this kind cuts texts into. Fixed value.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Side:
    """A tokenizer: ``encode`` gives the ids of all words, each with a space before it, and their number a word; ``tokens`` are the bytes of each id."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int32)
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._heads = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens."""
        n = self.lengths[ids]
        ends = np.cumsum(n, dtype=np.int64)
        return self._bytes[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - self._heads[ids], n)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size


@cache
def byte_level(path: str) -> Side:
    """A byte-level BPE file of the ``tokenizers`` library; special tokens in texts are plain text.

    If its ids are in the order of its merges, ids are ranks, and ``tiktoken`` encodes by
    them some six times faster; other files are encoded by ``tokenizers`` itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    # Byte-level vocabularies write printable bytes as themselves and the others as U+0100 and up, in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    tokens = [b""] * model.get_vocab_size()
    for text, i in model.get_vocab().items():
        tokens[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()

    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in own["model"]["merges"]]
    cut = own["pre_tokenizer"]
    ranked = all(own["model"]["vocab"].get(m) == 256 + k for k, m in enumerate(merges)) and not own["normalizer"]
    if not (ranked and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]):
        return Side(lambda words: _flat([e.ids for e in model.encode_batch_fast([" " + w for w in words.to_pylist()], add_special_tokens=False)]), tokens)
    ranks = tiktoken.Encoding(os.path.basename(path), pat_str=_PIECES, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(merges)])}, special_tokens={})

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Only after a word that ends in a plain character is the next one sure to begin a piece.
        alone = pc.match_substring_regex(words, _OPEN_END).to_numpy(zero_copy_only=False)
        together = words.filter(pa.array(~alone))
        ids = np.array(ranks.encode_ordinary("".join([" " + w for w in together.to_pylist()])), np.int32)
        ends = np.cumsum(pc.binary_length(together).to_numpy() + 1)
        size = np.diff(np.searchsorted(np.cumsum(side.lengths[ids], dtype=np.int64), ends, side="right"), prepend=0)
        if not alone.any():
            return ids, size
        more = _flat([ranks.encode_ordinary(" " + w) for w in words.filter(pa.array(alone)).to_pylist()])
        place = np.empty(len(words), np.int64)
        place[~alone], place[alone] = np.arange(len(together)), np.arange(len(together), len(words))
        return _expanded(np.append(ids, more[0]), np.append(size, more[1]), place)

    side = Side(encode, tokens)
    return side


@cache
def pieces(path: str) -> Side:
    """A model of the ``sentencepiece`` library that adds the leading space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^\u2581]\u2581", n) for n in names):
        raise ValueError("a piece holds a space after another character, so words cannot be encoded apart")
    tokens = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("\u2581", " ").encode() for n in names]
    return Side(lambda words: _flat(model.encode(words.to_pylist(), num_threads=1)), tokens)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null and empty ones have none) and the row of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    awkward = pc.match_substring_regex(texts, _AWKWARD).to_numpy(zero_copy_only=False) & filled
    plain = np.flatnonzero(filled & ~awkward)
    split = pc.split_pattern(texts.take(pa.array(plain)), " ")
    rows = [np.repeat(plain, pc.list_value_length(split).to_numpy(zero_copy_only=False))]
    words = [split.flatten()]
    for r in np.flatnonzero(awkward):
        own = _CUT.split(texts[int(r)].as_py())
        rows.append(np.full(len(own), r))
        words.append(pa.array(own, pa.large_string()))
    if len(words) == 1:
        return words[0], rows[0]
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return pa.concat_arrays(words).take(pa.array(order)), row[order]


def _same(side: Side, ids: np.ndarray, size: np.ndarray, words: pa.Array) -> np.ndarray:
    """Whether the tokens of each word give back a space and the word."""
    want, _ = text_bytes(pc.binary_replace_slice(words, 0, 0, " "))
    ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
    have, last = side.joined(ids), np.cumsum(size) - 1
    if len(have) == len(want) and np.array_equal(have, want):
        return np.cumsum(side.lengths[ids], dtype=np.int64)[last] == ends
    names = [b" " + w.encode() for w in words.to_pylist()]
    return np.array([b"".join(side.tokens[i] for i in ids[hi + 1 - n : hi + 1].tolist()) == w for w, n, hi in zip(names, size.tolist(), last.tolist())], bool)


def _expanded(ids: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``code`` in order, and the number of ids of each word."""
    n = size[code]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - (np.cumsum(size) - size)[code], n)
    return ids[at], n


@dataclass
class Tokens:
    """Tokens of one side over a batch: id, row, and byte range counted through the batch."""

    id: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def encode(texts: pa.Array, sides: tuple[Side, Side]) -> list[Tokens]:
    """Both sides' tokens of all texts whose joined bytes are a space and the text on both sides."""
    word, row = _words(texts)
    coded = word.dictionary_encode()
    code, names = coded.indices.to_numpy(), coded.dictionary
    nothing = Tokens(*[np.zeros(0, t) for t in (np.int32, np.int32, np.int64, np.int64)])
    if not len(names):
        return [nothing, nothing]
    ids = [side.encode(names) for side in sides]
    same = np.logical_and(*[_same(side, *i, names) for side, i in zip(sides, ids)])
    lost = np.zeros(len(texts), bool)
    lost[row[~same[code]]] = True
    kept = ~lost[row]
    code, row = code[kept], row[kept]
    out = []
    for side, i in zip(sides, ids):
        token, n = _expanded(*i, code)
        end = np.cumsum(side.lengths[token], dtype=np.int64)
        out.append(Tokens(token, np.repeat(row, n).astype(np.int32), end - side.lengths[token], end))
    return out


def covering(a: Tokens, b: Tokens) -> np.ndarray:
    """For each token of ``a`` the place in ``b`` of the token that covers its start."""
    left = pd.DataFrame({"start": a.start, "row": a.row}, copy=False)
    right = pd.DataFrame({"start": b.start, "row": b.row, "at": np.arange(len(b.id), dtype=np.int64)}, copy=False)
    return pd.merge_asof(left, right, on="start", by="row")["at"].to_numpy()


@dataclass
class Aligned:
    """``ends[k]`` marks the tokens of side k that end together with one of the other side; ``overlaps`` counts a row's overlapping pairs."""

    ends: tuple[np.ndarray, np.ndarray]
    overlaps: np.ndarray


def align(a: Tokens, b: Tokens, rows: int) -> Aligned:
    """Overlaps of both directions, and those of them whose ends are equal."""
    if not len(a.id):
        return Aligned((np.zeros(0, bool), np.zeros(0, bool)), np.zeros(rows, np.int64))
    of_a, of_b = covering(a, b), covering(b, a)
    # A pair found from both starts begins together; counted from a's side alone.
    again = a.start[of_b] == b.start
    overlaps = np.bincount(a.row, minlength=rows) + np.bincount(b.row[~again], minlength=rows)
    end_a, end_b = np.zeros(len(a.id), bool), np.zeros(len(b.id), bool)
    hit = a.end == b.end[of_a]
    end_a[hit], end_b[of_a[hit]] = True, True
    hit = ~again & (b.end == a.end[of_b])
    end_b[hit], end_a[of_b[hit]] = True, True
    return Aligned((end_a, end_b), overlaps)


@cache
def _labels(a: int, b: int) -> np.ndarray:
    """Ids as text with the sign that follows: ``,`` inside a group's side, ``|`` and ``;`` after its sides."""
    return np.array([f"{i}{sign}" for n, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(n)], object)


def digests(a: Tokens, b: Tokens, found: Aligned, rows: int, sizes: tuple[int, int]) -> list[str]:
    """SHA-256 of each row's groups as ``a1,a2|b1;a3|b2,b3``; empty for a row without tokens."""
    end_a, end_b = found.ends
    la, lb = np.flatnonzero(end_a) + 1, np.append(0, np.flatnonzero(end_b) + 1)
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    label = np.zeros(len(a.id) + len(b.id), np.int32)
    label[np.arange(len(a.id)) + lb[group_a]] = a.id + end_a * np.int32(sizes[0])
    label[np.arange(len(b.id)) + la[group_b]] = b.id + (2 * sizes[0] + end_b * np.int32(sizes[1]))
    bounds = np.append(0, np.cumsum(np.bincount(a.row, minlength=rows) + np.bincount(b.row, minlength=rows)))
    names = _labels(*sizes)
    return [hashlib.sha256("".join(names[label[lo:hi]].tolist())[:-1].encode()).hexdigest() if lo < hi else "" for lo, hi in zip(bounds[:-1], bounds[1:])]


def _pairs(a: Tokens, b: Tokens, found: Aligned, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair of ids and number of links, for each row's distinct linked pairs."""
    la, lb = np.flatnonzero(found.ends[0]), np.flatnonzero(found.ends[1])
    bits = (sizes[0] * sizes[1]).bit_length()
    key, times = np.unique(a.row[la].astype(np.int64) << bits | (a.id[la].astype(np.int64) * sizes[1] + b.id[lb]), return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), times


def _load(paths: tuple[str, str]) -> tuple[Side, Side]:
    return byte_level(paths[0]), pieces(paths[1])


def _encoded(batches, paths: tuple[str, str], kind: pa.DataType, most: int = SLICE):
    sides = _load(paths)
    sizes = len(sides[0].tokens), len(sides[1].tokens)
    for batch in small(batches, 1, most):
        rows = batch.num_rows
        a, b = encode(batch.column(1), sides)
        found = align(a, b, rows)
        row, pair, times = _pairs(a, b, found, sizes)
        heads = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
        links = np.bincount(a.row[found.ends[0]], minlength=rows)
        counts = [np.bincount(a.row, minlength=rows), np.bincount(b.row, minlength=rows), links, links, found.overlaps]
        yield pa.record_batch(
            [
                batch.column(0),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(digests(a, b, found, rows, sizes), pa.string()),
                pa.ListArray.from_arrays(heads, pa.array(pair, kind)),
                pa.ListArray.from_arrays(heads, pa.array(times, pa.int32())),
            ],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "times"],
        )


def encode_documents(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row per document: tokens of both sides, groups, links, overlaps, the groups' digest, and ``pairs`` of ids linked ``times`` times.

    A pair of ids is ``a * size of b + b``. Null and empty texts, and texts whose bytes one side
    does not give back, have no tokens. Rows are independent: repeated rows and ids give repeated
    results, null ids stay, other columns are not read, an empty table gives none. A batch is cut into
    slices of ``SLICE`` bytes of text; a longer text is a slice of its own.
    """
    a, b = _load(paths)
    kind = "int" if len(a.tokens) * len(b.tokens) < 1 << 31 else "long"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<{kind}>, times array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_encoded, paths=paths, kind=pa.int32() if kind == "int" else pa.int64()), schema)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """``pair, links``: how many links of the corpus hold each pair of ids.

    Of two tokens that end together one is a suffix of the other, so there are at most as many
    pairs as bytes in both vocabularies (times the ids that share their bytes, two at most):
    the table is bounded by the tokenizers, whatever the corpus.
    """
    each = encoded.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return each.groupBy(F.col("p.pairs").cast("long").alias("pair")).agg(F.sum("p.times").alias("links"))


def _summed(batches, pair: np.ndarray, links: np.ndarray, best: np.ndarray):
    for b in batches:
        lists, times = b.column(7), b.column(8).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(pair, lists.flatten().to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        sums = []
        for value in (best[at] * times, links[at] * times):
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, row, value)
            sums.append(pa.array(total))
        yield pa.record_batch([*[b.column(k) for k in range(7)], *sums], names=[*b.schema.names[:7], "n_best", "count_sum"])


def align_documents(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """:func:`encode_documents` with ``n_best``, links whose count is the highest of their b id (ties included), and ``count_sum``, the sum of links' counts.

    Texts are encoded once; the encoded rows are written to the shared folder. The table of
    pairs, which the vocabularies bound, is what tasks get whole.
    """
    encoded = materialize(encode_documents(docs, paths), "aligned")
    counts = pair_counts(encoded).toArrow()
    pair, links = counts.column("pair").to_numpy(), counts.column("links").to_numpy()
    order = np.argsort(pair)
    pair, links = pair[order], links[order]
    side = pair % len(_load(paths)[1].tokens)
    most = np.zeros(int(side.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, side, links)
    best = (links == most[side]).astype(np.int64)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, n_best long, count_sum long"
    return encoded.mapInArrow(partial(_summed, pair=pair, links=links, best=best), schema)
