"""Alignment of two tokenizers against a token-by-token account of whole texts."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
from messy import docs, messy_rows, no_docs  # noqa: F401
from pyspark.sql import functions as F

from triagelake.llm import crosstok
from triagelake.llm.queries import TOKENIZERS

ODD = [
    "a b", " a", "a ", "  a  b  ", " ", "   ", "a\n b", "a \n b", "a\t\tb ", "▁a", "a▁ b", "x  y", "a\x00 b", "<|endoftext|> <s> </s> <unk> <0x41>", "'s it's 're 'RE",
    "naïve cafés 日本語 テスト 😀 👩‍👩‍👧", "ﬁ ① ²", "a" * 3000, "ab " * 3000, "1234567 89 0.5e-3", "\x1c \x1d a \x85 b  c​ d", "...--- ***!!!", "é ñ", "﻿ a", "\U0001f1e9\U0001f1ea x", "b\n", "\nb", "c \t", "\t c", "d\n", "\u00a0d e",
]


def plain(texts):
    """Results by encoding whole texts and comparing all byte ranges of tokens that could end together."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(TOKENIZERS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=TOKENIZERS[1])
    sides = crosstok.byte_level(TOKENIZERS[0]).tokens, crosstok.pieces(TOKENIZERS[1]).tokens
    rows, count = [], Counter()
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        if any(b"".join(t[i] for i in x) != (" " + text).encode() for t, x in zip(sides, ids) if text):
            ids = [[], []]
        spans = []
        for t, x in zip(sides, ids):
            at, own = 0, []
            for i in x:
                own.append((at, at + len(t[i]), i))
                at += len(t[i])
            spans.append(own)
        ends = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        ending = [{}, {}]
        for side, own in zip(ending, spans):
            for _, e, i in own:
                side.setdefault(e, []).append(i)
        links = [(i, j) for e in sorted(ends) for i in ending[0][e] for j in ending[1][e]]
        count.update(links)
        overlaps = sum(1 for s, e, _ in spans[0] for u, v, _ in spans[1] if s < v and u < e) if len(ids[0]) < 900 else None
        groups, at = [], [0, 0]
        for e in sorted(ends):
            text = []
            for k, own in enumerate(spans):
                begin = at[k]
                while at[k] < len(own) and own[at[k]][1] <= e:
                    at[k] += 1
                text.append(",".join(str(i) for *_, i in own[begin : at[k]]))
            groups.append("|".join(text))
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, overlaps, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids[0] else ""))
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return [(n, m, g, len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), d, o) for n, m, g, k, o, d in rows]


def got(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_overlaps) for r in rows]


def same(x, y):
    return [p[:7] for p in x] == [q[:7] for q in y] and all(q[7] is None or p[7] == q[7] for p, q in zip(x, y))


def test_alignment_equals_whole_texts(table):
    rng = random.Random(1)
    odd = ODD + ["".join(rng.choice(["a", "Be", " ", "\n", "é", "▁", "1", ".", "'s", "日"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)] + [None, ""]
    df = table(list(enumerate(odd)), "doc_id long, text string")
    rows = sorted(crosstok.align_documents(df, TOKENIZERS).collect(), key=lambda r: r.doc_id)
    assert same(got(rows), plain(odd))
    assert sum(r.n_a == 0 for r in rows) >= 4
    # Results do not depend on the slices.
    batch = pa.record_batch([pa.array(range(len(odd))), pa.array(odd)], names=["doc_id", "text"])
    whole, cut = (pa.Table.from_batches(crosstok._encoded([batch], TOKENIZERS, pa.int32(), most)) for most in (4 << 20, 200))
    assert whole.equals(cut.combine_chunks()) and cut.column(0).num_chunks > 20


def test_alignment_of_messy_documents(docs, no_docs, messy_rows):
    rows = crosstok.align_documents(docs.withColumn("pairs", F.lit(1)), TOKENIZERS).collect()
    want = plain([r[1] for r in messy_rows])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    have = sorted(((r.doc_id, r.groups_sha256, g[:6]) for r, g in zip(rows, got(rows))), key=key)
    assert have == sorted(((m[0], w[6], w[:6]) for m, w in zip(messy_rows, want)), key=key)
    assert crosstok.align_documents(no_docs, TOKENIZERS).count() == 0


def test_pairs_are_bounded_by_the_vocabularies(docs):
    sides = crosstok._load(TOKENIZERS)
    counts = crosstok.pair_counts(crosstok.encode_documents(docs, TOKENIZERS)).collect()
    assert len(counts) <= 2 * sum(len(t) for s in sides for t in s.tokens)
    for r in counts:
        x, y = sides[0].tokens[r.pair // len(sides[1].tokens)], sides[1].tokens[r.pair % len(sides[1].tokens)]
        assert x.endswith(y) or y.endswith(x)


def test_ranks_encode_as_the_tokenizers_library(docs):
    """Every token of the vocabulary alone, and every code point between letters and between digits."""
    from tokenizers import Tokenizer

    side = crosstok.byte_level(TOKENIZERS[0])
    own = Tokenizer.from_file(TOKENIZERS[0])
    own.encode_special_tokens = True
    words = [t.decode("utf-8", "ignore") for t in side.tokens] + [f"x{chr(c)}y1{chr(c)}2" for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    words = [w for w in words if w and not set(w) & set(map(chr, [*range(33), 127, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]))]
    ids, size = side.encode(pa.array(words, pa.large_string()))
    want = own.encode_batch([" " + w for w in words], add_special_tokens=False)
    at = 0
    for w, n, e in zip(words, size.tolist(), want):
        assert ids[at : at + n].tolist() == e.ids, w
        at += n
