"""Formatted conversations against a plain account of each one."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from triagelake.llm import chat

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\\\|", "<", "|", "<|", "\\", "a<", "<|im_end|>\n<|im_start|>user\nhi", "é😀\n\n", "", None, "<<||", "\\<\\|\\", "x" * 5000]
DDL = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        roles = [r for *_, r, _ in turns]
        valid = re.fullmatch("(system )?(user assistant )+", " ".join(roles) + " ") is not None
        bad = next((i for i in range(len(roles)) if not re.fullmatch("(system )?(user assistant )*(user )?", " ".join(roles[: i + 1]) + " ")), None)
        marks = sum(24 + len(chat.write_role(r)) + len(t) + len(re.findall(r"<\\*\|", t)) for *_, r, t in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said), marks, valid, bad)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    rows = [(-1, 0, "user", HARD[0]), (-1, 1, "assistant", HARD[0])]
    for c in range(60):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randrange(1, 5)
        if c % 5 == 0:
            roles.insert(rng.randrange(len(roles) + 1), rng.choice(["user", "assistant", "tool", "a\nb<|", "\\", None, "system"]))
        rows += [(c, t, r, rng.choice([*HARD, f"text {c} {t}"])) for t, r in enumerate(roles)]
    # One conversation holds most turns; it breaks the order late.
    rows += [(100, t, "assistant" if t % 2 else "user", f"{t} {rng.choice(HARD)}") for t in range(700)] + [(100, 700, "assistant", "x")] * 2
    rows += [(101, t, "assistant" if t % 2 else "user", str(t)) for t in range(300)]
    rows += [(102, None, "user", "a"), (102, None, "assistant", "b"), (102, 4, "user", "c"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (103, 0, "user", None)]
    rows += [(104, 0, "user", "same")] * 3 + [(105, -5, "user", "q"), (105, 1 << 40, "assistant", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part_turns", [1, 7, 100, 4096])
def test_conversations_come_back(table, rows, part_turns):
    df = table(rows, DDL).withColumn("part", F.lit("x")).withColumn("state", F.lit(1)).repartition(4)
    want = plain(rows)
    got = chat.digests(df, part_turns=part_turns).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    formatted = chat.format_conversations(df, part_turns=part_turns)
    assert {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted).collect()} == want
    if part_turns == 100:
        parts = [r for r in formatted.collect() if r.conv_id == 100]
        assert len(parts) > 4 and max(r.turns for r in parts) <= 702


def test_formatted_text_and_spans(table):
    (r,) = chat.format_conversations(table([(1, 0, "user", "Hi"), (1, 1, "assistant", "a <|b")], DDL)).collect()
    assert r.text == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\na <\\|b<|im_end|>\n"
    assert [r.text[s.start : s.end] for s in r.loss] == ["a <\\|b"] and r.state == "assistant" and r.bad_turn is None


def test_other_templates(table):
    every = frozenset({"a", "b"})
    own = chat.Template((("<|t|>", frozenset()), (chat.ROLE, frozenset()), ("\n", frozenset()), (chat.TEXT, every), ("<|e|>", every)), {("start", "a"): "a", ("a", "b"): "b"}, accepting=frozenset({"b"}))
    (r,) = chat.format_conversations(table([(1, 0, "a", "x"), (1, 1, "b", "y")], DDL), own).collect()
    assert [r.text[s.start : s.end] for s in r.loss] == ["x", "<|e|>", "y", "<|e|>"] and r.state == "b"
    with pytest.raises(ValueError):
        chat.Template((("#", frozenset()), (chat.TEXT, frozenset())), {})


def test_no_conversations(table, rows):
    df = table(rows, DDL).filter("false")
    assert chat.digests(df).count() == 0 and chat.format_conversations(df).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\\nab") for _ in range(rng.randrange(9)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert not set("\n<") & set(chat.write_role(text)) and chat.read_role(chat.write_role(text)) == text
