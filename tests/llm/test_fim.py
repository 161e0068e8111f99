"""Ropes against slices of strings, the transformation against the rule by hand, and exact round trips."""

import hashlib
import random

import pytest
import regex

from rankloom.llm import fim
from tests.llm.test_operators import EDGE, LONG, docs


def by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def units_by_hand(text, pattern):
    """The ends of all units."""
    ends, at = [], 0
    for m in regex.finditer(pattern, text):
        if m.end() > m.start():
            ends += [*range(at + 1, m.start() + 1), m.end()]
            at = m.end()
    return ends + list(range(at + 1, len(text) + 1))


@pytest.mark.parametrize("pattern", [None, r"\w+", r"\s*\S+", r"x*", r"(?s)..", "nothing like it"])
def test_split_and_concatenate(monkeypatch, pattern):
    monkeypatch.setattr(fim, "LEAF", 3)
    draw = random.Random(7)
    for _ in range(60):
        text = "".join(draw.choice("ab x\né\U0001f600<PSM>") for _ in range(draw.randrange(0, 50)))
        rope = fim.rope_of(text, pattern)
        ends = list(range(1, len(text) + 1)) if pattern is None else units_by_hand(text, pattern)
        assert (rope.units if rope else 0) == len(ends) and fim.text_of(rope) == text
        for k in range(-1, len(ends) + 2):
            a, b = fim.split(rope, k)
            cut = 0 if k <= 0 else len(text) if k >= len(ends) else ends[k - 1]
            assert (fim.text_of(a), fim.text_of(b)) == (text[:cut], text[cut:])
            assert (a.units if a else 0) + (b.units if b else 0) == len(ends)
            assert (a.chars if a else 0) == cut
            assert fim.text_of(fim.concat(b, a)) == text[cut:] + text[:cut]
        for k in range(len(text) + 1):
            a, b = fim.split(rope, k, False)
            assert (fim.text_of(a), fim.text_of(b)) == (text[:k], text[k:])


def height(rope):
    return 0 if rope is None or isinstance(rope, fim.Leaf) else 1 + max(height(rope.left), height(rope.right))


def test_splits_keep_the_height(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 1)
    rope = fim.rope_of("x" * 4096)
    draw = random.Random(3)
    for _ in range(100):
        a, b = fim.split(rope, draw.randrange(4097))
        assert height(a) <= height(rope) and height(b) <= height(rope)
    assert height(rope) == 12


def test_inverse_finds_sentinels_across_leaves(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 2)
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("<PSM>a") for _ in range(draw.randrange(0, 14)))
        if any(x in text for x in fim.SENTINELS):
            continue
        a, b = sorted(draw.randrange(len(text) + 1) for _ in range(2))
        for form in ("psm", "spm"):
            parts = [fim.rope_of(x) for x in (text[:a], text[a:b], text[b:])]
            assert fim.invert(fim.text_of(fim.arrange(*parts, form)), form) == text
    with pytest.raises(ValueError):
        fim.invert("<P>no middle<S>", "psm")


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", ">S", "<M>")])
def test_sentinels_that_could_arise_are_refused(spark, bad):
    with pytest.raises(ValueError):
        fim.transform(docs(spark, EDGE), "doc_id", sentinels=bad)


MORE = [*EDGE, (20, "holds <S> itself"), (21, "<P"), (22, "a"), *((100 + i, f"text number {i} with é and \U0001f600 <P < S>" * (i % 7)) for i in range(120))]


def test_transform_and_restore(spark):
    rows = fim.transform(docs(spark, MORE), "doc_id", "digest", "key")
    back = fim.restore(rows)
    assert back.columns == [*(c for c in rows.columns if c != "output"), "restored"]
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["digest"], r["key"]) for r in rows.collect()), key=str)
    assert got == sorted(((i, *by_hand(i, t), "d", "k") for i, t in MORE), key=str)
    assert sorted((r["doc_id"], r["restored"]) for r in back.where("doc_id is not null").collect()) == sorted((i, t or "") for i, t in MORE if i is not None)
    assert {r["form"] for r in rows.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_units_of_words(spark):
    rows = fim.restore(fim.transform(docs(spark, [(i, f"one two  three\n{i} " * 9) for i in range(40)]), "doc_id", unit=r"\w+", transformed=100))
    for r in rows.collect():
        text = f"one two  three\n{r['doc_id']} " * 9
        ends = units_by_hand(text, r"\w+")
        cut = lambda k: ends[k - 1] if k else 0
        assert r["n"] == len(ends) and r["restored"] == text
        assert r["prefix_chars"] == cut(r["prefix_units"])
        assert r["middle_chars"] == cut(r["prefix_units"] + r["middle_units"]) - cut(r["prefix_units"])


def test_empty_and_null(spark):
    assert fim.restore(fim.transform(docs(spark, []), "doc_id")).count() == 0
    assert [r["restored"] for r in fim.restore(spark.createDataFrame([(None, "psm"), ("x", None), ("y", "plain")], "output string, form string")).collect()] == [None, None, "y"]


def test_very_long_text(spark):
    text = LONG * 5
    got = fim.restore(fim.transform(docs(spark, [(i, text) for i in range(4)]), "doc_id", transformed=100)).collect()
    assert all(r["restored"] == text and r["n"] == len(text) for r in got)
