"""Operators against plain Python on small tables, and inputs that once lost rows or crashed."""

import random
import re

import numpy as np
import pytest

from rankloom.llm import bpe, decontam, packing, simhash, toxicity

CLASHING = ["id_", "of_", "row", "id", "of", "first", "group", "first_", "text_", "of_text", "score", "predicted"]


def clashing(spark, rows):
    """rows of (doc_id, text) with columns named like those inside the operators."""
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))


# decontamination


def readings_by_hand(text):
    """For each reading the (template token, slot or None, token) of what counts."""
    tokens = re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n%$€£+*/=×÷]|(?<![^\W_])-(?=\s*\d)", text)
    out = [[], [], []]
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else "."
        low = t.lower()
        number = before[0].isdigit()
        word_number = before.lower() in decontam.NUMBERS
        capital = len(t) > 1 and t[0].isupper() and t[1:] == t[1:].lower() and low not in decontam.UNITS
        if t in ".!?\n" or t in "%$€£" and not number:
            continue
        if t[0].isdigit():
            kinds = ("number", "number")
        elif low in decontam.UNITS and number:
            kinds = ("unit", "unit")
        elif low in decontam.NUMBERS:
            kinds = ("name" if capital and before not in ".!?\n" else None, "number")
        elif capital:
            kinds = ("name" if before not in ".!?\n" else None, "name" if low not in decontam.FUNCTION else None)
            kinds = (kinds[0], kinds[1] or kinds[0])
        elif low in decontam.UNITS and word_number:
            kinds = (None, "unit")
        else:
            kinds = (None, None)
        for reading, kind in ((0, kinds[0]), (2, kinds[1])):
            out[reading].append((f"<{kind}>" if kind else low, kind, low))
        if t not in "+*/=×÷-":
            out[1].append((low, None, low))
    return out


def pieces(seq, size):
    return [(at, seq[at : at + size]) for at in range(len(seq) - size + 1) if sum(k is None for _, k, _ in seq[at : at + size]) >= min(3, size)]


def agrees(pairs):
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def contained_by_hand(text, item):
    best, run = 0.0, 0
    for doc, own in zip(readings_by_hand(text), readings_by_hand(item)):
        size = min(5, len(own))
        if size < 3:
            continue
        mine = pieces(own, size)
        theirs = pieces(doc, size)
        lines = {}
        for d_at, d in theirs:
            for nth, (i_at, i) in enumerate(mine):
                if [x[0] for x in d] == [x[0] for x in i]:
                    slots, places = lines.setdefault(d_at - i_at, (set(), {}))
                    slots |= {((k, a), (k, b)) for (_, k, a), (_, _, b) in zip(i, d) if k}
                    places[i_at] = nth
        good = sorted((-len(places), at) for at, (slots, places) in lines.items() if agrees(slots))
        slots, covered = set(), set()
        for _, at in good:
            if agrees(slots | lines[at][0]):
                slots |= lines[at][0]
                covered |= set(lines[at][1])
            words, last, stop = 0, None, 0
            for i_at, nth in sorted(lines[at][1].items()):
                words = words + i_at + size - max(stop, i_at) if last is not None and nth == last + 1 else size
                last, stop = nth, i_at + size
                run = max(run, words)
        if mine:
            best = max(best, len(covered) / len(mine))
    return best if best >= 0.5 or run >= 13 else None


@pytest.mark.parametrize("most", [decontam.IN_WORKERS, 0])
def test_decontamination_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "IN_WORKERS", most)
    rng = random.Random(most + 1)
    words = "the cat has 3 5 12 apples Tom Ann Eva km dollars and then gives two four to of . ? , in Market street + = what is".split()
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 4, 6, 12, 30]))) for _ in range(25)] + ["What is 12 + 7?"]
    docs = ["What is 15 + 9?", "What is 15 9?"]
    for i in range(120):
        item = rng.choice(items).split()
        for old, new in rng.sample([("Tom", "Max"), ("Ann", "Zoe"), ("3", "8"), ("12", "77"), ("two", "9"), ("km", "cm"), ("Tom", "Ann")], 3):
            item = [new if x == old and rng.random() < 0.9 else x for x in item]
        cut = rng.randrange(len(item) + 1)
        docs.append(" ".join([*(rng.choice(words) for _ in range(rng.randrange(9))), *item[:cut], *(["so"] * rng.randrange(2)), *item[cut:], *(rng.choice(words) for _ in range(rng.randrange(9)))]))
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 9) for r in decontam.matches(clashing(spark, list(enumerate(docs))), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()}
    want = {(d, i): round(c, 9) for d, t in enumerate(docs) for i, x in enumerate(items) if (c := contained_by_hand(t, x)) is not None}
    assert got == want and (0, 25) in want and (1, 25) not in want and len(want) > 60


def test_contradictory_halves(spark):
    item = "Yesterday Alice walked to the old mill by the river with bread. In the evening the miller paid Alice seven coins for bread and flour."
    half = item.replace("Alice", "Maria", 1).replace("Alice", "Susan").replace("bread. In", "bread, or so they said here. In")
    whole = half.replace("Susan", "Maria")
    got = {r["doc_id"]: r["containment"] for r in decontam.matches(spark.createDataFrame([(1, half), (2, whole)], "doc_id int, text string"), spark.createDataFrame([("x", item)], "item_id string, text string")).collect()}
    assert 2 in got and got.get(1, 0) < got[2]


def test_clashing_names(spark):
    df = clashing(spark, [(1, "one two three four five six seven"), (2, None), (3, "one two three four five six seven"), (3, "other words that nobody wrote before in this place")])
    bench = spark.createDataFrame([("a", "other words that nobody wrote before")], "item_id string, text string")
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench).collect()) == [1, 2, 3]
    assert {(r["doc_id"], r["item_id"]) for r in decontam.flag(df, bench).collect()} == {(1, None), (2, None), (3, None), (3, "a")}
    kept = simhash.near_deduplicate(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, "one two three four five six seven"), (2, ""), (3, "other words that nobody wrote before in this place")]


# near duplicates


def test_one_id_with_unlike_texts(spark):
    a, b, c = "a text about boats and nets", "quite another text about hills and wolves", "third words without any tie to others here"
    rows = [(2, a), (6, a), (6, b), (9, c), (None, c), (None, "only nulls have this text in all the table"), (None, "only nulls have this text in all the table"), (6, b)]
    kept = simhash.near_deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, a), (6, b), (9, c), rows[5]], key=str)


# packing


def test_very_long_white_space(spark):
    path, pattern = bpe.vocabulary("byte_bpe_50k.tiktoken")
    texts = ["a" + " " * 3_000_000 + "b", "x \t" * 400 + "\n" * 2000, " " * 999]
    got = {}
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path, pattern).collect():
        ids = np.frombuffer(r["ids"], "<i4")
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            got.setdefault(doc, {})[start] = ids[a:b].tolist()
    own = bpe.tokenizer(path, pattern)
    for i, t in enumerate(texts):
        ids = [x for _, part in sorted(got[i].items()) for x in part]
        assert own.decode(ids) == t


# toxicity


def test_sample_by_row(spark, monkeypatch):
    """A text on most rows neither vanishes from the sample nor floods it, and kept columns may be named like results."""
    monkeypatch.setattr(toxicity, "UNLABELLED", 400)
    monkeypatch.setattr(toxicity, "POSITIVES", 50)
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda p, u, prior: seen.update(p=p, u=u, prior=prior))
    rows = [(i, "always the same words" if i % 3 else ("zorg " if i % 4 == 0 else "") + f"own{i} words") for i in range(3000)]
    df = clashing(spark, rows)
    labels = spark.createDataFrame([(i, int("zorg" in t)) for i, t in rows if i % 2 == 0], "doc_id bigint, toxic int")
    toxicity.fit(df, labels)
    same = sum("always" in f for f in seen["u"]) / len(seen["u"])
    assert 300 < len(seen["u"]) < 500 and 0.55 < same < 0.78 and any("zorg" in f for f in seen["u"])
    assert 30 < len(seen["p"]) < 75 and all("zorg" in f for f in seen["p"])
    assert abs(seen["prior"] - sum("zorg" in t for i, t in rows if i % 2 == 0) / 1500) < 1e-9
    got = toxicity.score(df, toxicity.Classifier({"zorg": 3.0}, -1.0), "doc_id", "score", "row")
    assert got.columns == ["doc_id", "score_", "row", "score", "predicted"]
    assert {r["doc_id"] for r in got.where("predicted = 1").collect()} == {i for i, t in rows if "zorg" in t}


def test_long_and_repeated_toxic_texts():
    m = toxicity.Classifier({"zorg": 3.0, "zorg~": 1.0}, -1.0)
    assert m.score("word " * 200_000 + "zorg") == m.score("zorg " * 50_000) > 0.9 > m.score("")
