"""License notices in texts: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.arrays import U64, runs, small, text_bytes, words_of

#: Words of a fingerprint and fingerprints of a window: runs of GRAM + WINDOW - 1 words always share one.
GRAM, WINDOW = 3, 2
#: Insertions or deletions between a text and a template that an alignment can follow.
BAND = 8
#: Share of a template's words that must be matched.
COVERAGE = 0.75

# Wordings of public license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the least fingerprint of every window, the rightmost of equals; all of a short sequence's windows are one."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    n = len(grams) - WINDOW + 1
    low, at = grams[:n].copy(), np.arange(n)
    for k in range(1, WINDOW):
        other = grams[k : k + n]
        take = other <= low
        low[take], at[take] = other[take], np.flatnonzero(take) + k
    return np.unique(at)


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    template: np.ndarray
    place: np.ndarray


def build(templates: list[tuple[str, str]]) -> Index:
    """An inverted index from fingerprints to templates and places; templates need ``GRAM`` words."""
    words = [words_of(pa.array([t]), punctuation=True).hash for _, t in templates]
    rows = [(int(g[p]), i, int(p)) for i, w in enumerate(words) for g in [runs(w, GRAM)] for p in winnow(g)]
    rows.sort()
    return Index([n for n, _ in templates], words, np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def align(text: np.ndarray, template: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """``matched, first, last``: the most template words matched in order, and the text words they span.

    ``text`` begins ``band`` words before the place where the template would start: word j of the
    template is looked for at text words j to j + 2 * band. Of equal numbers, the shortest span wins.
    """
    width = 2 * band + 1
    # best[k]: most words matched by the template so far up to text word j + k, where that began and ended.
    best = [(0, 0, -1)] * (width + 1)
    for j in range(len(template)):
        # One word further in the template, the band is one word further in the text.
        best = best[1:] + [best[-1]] if j else best
        row = list(best)
        for k in range(width):
            i = j + k
            if i < len(text) and text[i] == template[j]:
                count, first, _ = (best_before[k] if j else (0, 0, -1))
                row[k] = max(row[k], (count + 1, first if count else i, i), key=lambda s: (s[0], s[1], -s[2]))
        for k in range(1, width + 1):
            row[k] = max(row[k], row[k - 1], key=lambda s: (s[0], s[1], -s[2]))
        best_before, best = row, row
    count, first, last = best[-1]
    return count, first, last


def scan(texts: pa.Array, index: Index) -> list[tuple[int, int, float, int, int]]:
    """``row, template, coverage, start, end`` (bytes) of every stretch of a text that matches a template best."""
    words = words_of(texts, punctuation=True)
    if len(words.hash) < GRAM:
        return []
    grams = runs(words.hash, GRAM)
    low = np.searchsorted(index.keys, grams)
    low[low == len(index.keys)] = 0
    out = []
    found = np.flatnonzero(index.keys[low] == grams)
    if not len(found):
        return []
    row = np.searchsorted(words.bounds, found, side="right") - 1
    for r in np.unique(row):
        lo, hi = int(words.bounds[r]), int(words.bounds[r + 1])
        own = words.hash[lo:hi]
        if len(own) < GRAM:
            continue
        g = runs(own, GRAM)
        spots: set[tuple[int, int]] = set()
        near = found[row == r] - lo
        # Windows around a shared fingerprint decide whether it is a winnowed one of the text.
        picked = set()
        for p in near[near < len(g)]:
            a = max(0, int(p) - WINDOW + 1)
            picked |= {a + int(q) for q in winnow(g[a : int(p) + WINDOW])} & {int(p)}
        for p in picked:
            k = int(np.searchsorted(index.keys, g[p]))
            while k < len(index.keys) and index.keys[k] == g[p]:
                spots.add((int(index.template[k]), p - int(index.place[k])))
                k += 1
        hits = []
        for t, start in sorted(spots):
            template = index.words[t]
            # Not wider than half the template, so that a short notice does not slide to its next copy.
            band = min(BAND, len(template) // 2)
            begin = start - band
            text = own[max(0, begin) : start + len(template) + band]
            if begin < 0:
                text = np.append(np.zeros(-begin, U64), text)
            matched, first, last = align(text, template, band)
            if matched and matched >= COVERAGE * len(template):
                hits.append((matched, -(last - first), matched / len(template), t, begin + first, begin + last))
        # Of overlapping stretches the one that matches most stays, then the shortest, then the most complete.
        used: list[tuple[int, int]] = []
        for matched, _, share, t, first, last in sorted(hits, key=lambda h: (-h[0], -h[1], -h[2], h[3], h[4])):
            if all(last < a or first > b for a, b in used):
                used.append((first, last))
                out.append((int(r), t, share, int(words.start[lo + first]), int(words.end[lo + last])))
    return out


_FOUND = "doc_id long, license string, template int, coverage double, start int, end int"


def _found(batches, index: Index):
    for b in small(batches, 1):
        rows = scan(b.column(1), index)
        raw, offsets = text_bytes(b.column(1))
        chars = [[len(raw[offsets[r] : at].tobytes().decode("utf-8", "replace")) for at in (s, e)] for r, _, _, s, e in rows]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.record_batch(
            [b.column(0).take(at), pa.array([index.names[r[1]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([c[0] for c in chars], pa.int32()), pa.array([c[1] for c in chars], pa.int32())],
            names=["doc_id", "license", "template", "coverage", "start", "end"],
        )


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row for each stretch of a text that matches a template: license, number of the template, coverage, start and end in characters.

    A stretch is a candidate if a winnowed fingerprint of the text is one of a template; it
    counts if the banded alignment matches at least ``COVERAGE`` of the template's words in order. Of overlapping
    stretches the best stays. Null and empty texts match nothing, repeated rows give repeated results, other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_found, index=build(templates)), _FOUND)
