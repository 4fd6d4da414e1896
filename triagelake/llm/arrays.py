"""Whole Arrow batches of texts as arrays of word hashes, and small array helpers.

Words are the runs of bytes other than space and the control characters 9 to 13, with
A-Z lowered. A word is known by a 64-bit hash of its bytes; two of the words of a corpus
with a billion distinct words share a hash with a probability of about three per cent.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes hashed at a time; bounds the memory of a step, not the length of a text.
STEP = 1 << 21

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a batch in order: hash, and the row each belongs to; ``bounds[i]:bounds[i+1]`` is row i."""

    hash: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


@cache
def _signs() -> np.ndarray:
    """For each code point whether it is a sign: punctuation, a symbol or a blank beyond ASCII."""
    return np.array([c > 127 and unicodedata.category(chr(c))[0] in "PSZ" for c in range(0x110000)], bool)


def _without_signs(raw: np.ndarray) -> np.ndarray:
    """UTF-8 with every byte of a sign beyond ASCII replaced by a blank, so that places stay."""
    out = raw
    for lo in range(0, len(raw), STEP):
        part = raw[lo : lo + STEP]
        for size, least, most, mask in ((2, 0xC2, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF5, 0x07)):
            at = np.flatnonzero((part >= least) & (part < most)) + lo
            at = at[at + size <= len(raw)]
            code = raw[at].astype(np.int64) & mask
            for k in range(1, size):
                code = code << 6 | (raw[at + k] & 0x3F)
            at = at[_signs()[np.minimum(code, 0x10FFFF)]]
            if len(at):
                out = out.copy() if out is raw else out
                for k in range(size):
                    out[at + k] = 32
    return out


def words_of(texts: pa.Array, punctuation: bool = False, signs: bool = False, gap: np.ndarray | None = None) -> Words:
    """Words of all texts; with ``punctuation``, ASCII punctuation parts words as blanks do, with ``signs`` also all other Unicode punctuation, symbols and blanks; ``gap`` names the bytes that part words instead."""
    if gap is None:
        gap = _PUNCT if punctuation or signs else _SPACE
    raw, offsets = text_bytes(texts)
    if signs:
        raw = _without_signs(raw)
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    hashes, starts, ends = [], [], []
    lo = 0
    while lo < n:
        hi = min(lo + STEP, n)
        while hi < n and not (first[hi] or gap[raw[hi]]):
            hi += 1
        solid = ~gap[raw[lo:hi]]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[lo + 1 : hi]
        at = np.flatnonzero(solid)
        if len(at):
            begin = np.flatnonzero(begins)
            head = np.searchsorted(at, begin)
            length = np.diff(np.append(head, len(at)))
            local = np.arange(len(at)) - np.repeat(head, length)
            value = (_LOWER[raw[lo:hi][at]].astype(U64) + U64(1)) * _POWERS[local & 4095]
            hashes.append(mix(np.add.reduceat(value, head) + length.astype(U64) * _ODD))
            starts.append(begin + lo)
            ends.append(begin + lo + length)
        lo = hi
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, U64),
        np.searchsorted(start, offsets),
        start,
        np.concatenate(ends) if ends else empty,
    )


def small(batches, column: int, most: int = 8 << 20):
    """The batches cut into slices of about ``most`` bytes of text, a row at least; bounds the memory of a step."""
    for b in batches:
        _, offsets = text_bytes(b.column(column))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def hash_word(word: str) -> int:
    """The hash :func:`words_of` gives to this word."""
    return int(words_of(pa.array([word])).hash[0])


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive values; shorter by ``size - 1``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out *= _ODD
        out += hashes[k : k + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles of one text; the whole sequence if it is shorter than a shingle."""
    if not len(hashes):
        return np.zeros(0, U64)
    return np.unique(runs(hashes, min(size, len(hashes)))) if len(hashes) >= size else runs(hashes, len(hashes)) + U64(len(hashes))


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def deal(part: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Positions of each partition that has any, in stable order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cuts[p] : cuts[p + 1]]) for p in range(parts) if cuts[p] < cuts[p + 1]]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges as (node, smallest node of its tree), without the roots."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = flat[: len(u)], flat[len(u) :]
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
