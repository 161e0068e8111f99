"""Rankers against brute force."""

import math
import random
import re

import pytest

from rankloom.functions import exact
from rankloom.functions.text import STOPWORDS
from rankloom.operators import rankers

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(30)]
TEXTS = {f"d{n:02d}": " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 60))) for n in range(25)} | {"d90": "w28 x w29", "d91": "The w1 of w2, w3: Éa éa!", "d92": "", "d93": None}
ITEMS = {"q1": " ".join(WORDS), "q2": " ".join(WORDS[::-1] + WORDS[:3]), "q3": "w1", "q4": "w1 of W2", "q5": "the of", "q6": "éa w3 nowhere"}


def rows(spark, texts, key):
    return spark.createDataFrame(list(texts.items()), f"{key} string, text string")


def scores(df):
    return {(r["qid"], r["docid"]): r["score"] for r in df.collect()}


def tokens(text):
    return [t for t in re.findall(r"[^\W_]+", (text or "").lower()) if len(t) > 1 and t not in STOPWORDS]


def by_hand(part, norm=lambda x, t: x):
    docs = {d: tokens(t) for d, t in TEXTS.items()}
    n, c = len(docs), sum(map(len, docs.values()))
    df = {w: sum(w in t for t in docs.values()) for t in docs.values() for w in t}
    cf = {w: sum(t.count(w) for t in docs.values()) for w in df}
    out = {}
    for q, item in ITEMS.items():
        for d, t in docs.items():
            found = [w for w in tokens(item) if w in t]
            if found:
                out[q, d] = norm(sum(part(t.count(w), df[w], cf[w], len(t), n, c) for w in (tokens(item) if part is likelihood else found) if w in df), t)
    return out


def likelihood(tf, df, cf, dl, n, c):
    return math.log((tf + 2000 * cf / c) / (dl + 2000))


def test_lexical_rankers(spark):
    c = rankers.Collection(rows(spark, ITEMS, "qid"), rows(spark, TEXTS, "docid"))
    bm = lambda tf, df, cf, dl, n, total: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / total))
    assert scores(rankers.bm25(c)) == pytest.approx(by_hand(bm), abs=1e-8)
    assert scores(rankers.tfidf(c)) == pytest.approx(by_hand(lambda tf, df, cf, dl, n, total: (1 + math.log(tf)) * math.log(n / (df + 1)), lambda x, t: x / math.sqrt(len(t))), abs=1e-8)
    assert scores(rankers.ql_dirichlet(c)) == pytest.approx(by_hand(likelihood), abs=1e-8)


def test_sides_too_great_for_a_broadcast(spark, monkeypatch):
    q, t = rows(spark, ITEMS, "qid"), rows(spark, TEXTS, "docid")
    want = scores(rankers.bm25(rankers.Collection(q, t)))
    monkeypatch.setattr(rankers, "ROWS", 0)
    c = rankers.Collection(q, t)
    assert scores(rankers.bm25(c)) == want and not c.few


def near_by_hand(item, text):
    text = text or ""
    raw, terms = re.findall("[a-z0-9]+", text.lower()), list(dict.fromkeys(re.findall("[a-z0-9]+", item.lower())))
    if not raw:
        return 0.0
    places = {w: [p for p, x in enumerate(raw) if x == w] for w in terms if w in raw}
    m, pairs = len(terms), [(a, b) for i, a in enumerate(terms) for b in terms[i + 1 :]]
    close = sum(1 / (1 + min(abs(x - y) for x in places[a] for y in places[b])) for a, b in pairs if a in places and b in places) / max(len(pairs), 1)
    early = sum(1 / (1 + p[0]) for p in places.values()) / m
    phrase = 0.0
    if m > 1:
        phrase = 1.0 if item.lower() in text.lower() else 0.3 * sum(f"{a} {b}" in text.lower() for a, b in zip(terms, terms[1:]))
    return 0.2 * len(places) / m + 0.4 * close + 0.15 * early + 0.25 * min(phrase, 1)


def test_rankers_of_candidates(spark):
    q, t = rows(spark, ITEMS, "qid"), rows(spark, TEXTS, "docid")
    pairs = [(a, b) for a in ITEMS for b in TEXTS]
    candidates = spark.createDataFrame(pairs, "qid string, docid string")
    assert scores(rankers.proximity(q, t, candidates)) == pytest.approx({(a, b): near_by_hand(ITEMS[a], TEXTS[b]) for a, b in pairs}, abs=1e-8)
    got = scores(rankers.semantic_hash(q, t, candidates))
    assert set(got) == set(pairs) and got["q3", "d92"] == 0 and max(got.values()) <= 1 + 1e-9
    assert scores(rankers.semantic_hash(q, rows(spark, {"x": ITEMS["q1"].upper()}, "docid"), spark.createDataFrame([("q1", "x")], "qid string, docid string")))["q1", "x"] == pytest.approx(1)


def test_bigrams_by_hand(spark):
    from collections import Counter

    q, t = rows(spark, ITEMS, "qid"), rows(spark, TEXTS, "docid")
    pairs = [(a, b) for a in ITEMS for b in TEXTS if (len(a + b) + int(b[1:])) % 3]
    got = scores(rankers.bigram_cosine(q, t, spark.createDataFrame(pairs, "qid string, docid string")))
    feats = lambda x: Counter(tokens(x) + [f"{a}_{b}" for a, b in zip(tokens(x), tokens(x)[1:])])
    want = {}
    for a in ITEMS:
        own = [b for x, b in pairs if x == a]
        every = [feats(ITEMS[a]), *(feats(TEXTS[b]) for b in own)]
        df = Counter(f for e in every for f in e)
        n = len(every)
        fit = {f for f in df if 2 <= df[f] < 0.95 * n} or set(df)
        vec = [{f: (1 + math.log(c)) * math.log(n / (df[f] + 1)) for f, c in e.items() if f in fit} for e in every]
        norm = [math.sqrt(sum(x * x for x in v.values())) for v in vec]
        for b, v, m in zip(own, vec[1:], norm[1:]):
            want[a, b] = sum(x * vec[0].get(f, 0) for f, x in v.items()) / (m * norm[0]) if m * norm[0] else 0.0
    assert got == pytest.approx(want, abs=1e-8)


def test_repeated_documents_count_once(spark):
    q, once = rows(spark, ITEMS, "qid"), rows(spark, TEXTS, "docid")
    again = once.unionByName(once.where("docid < 'd10'")).unionByName(once.where("docid = 'd03'"))
    pairs = spark.createDataFrame([(a, b) for a in ITEMS for b in TEXTS], "qid string, docid string")
    a, b = rankers.Collection(q, once), rankers.Collection(q, again)
    assert b.totals.first() == a.totals.first()
    for ranker in (rankers.bm25, rankers.tfidf, rankers.ql_dirichlet):
        assert scores(ranker(b)) == scores(ranker(a))
    for ranker in (rankers.proximity, rankers.bigram_cosine, rankers.semantic_hash):
        assert scores(ranker(q, again, pairs)) == scores(ranker(q, once, pairs))


def test_one_docid_with_two_texts_is_one_document(spark):
    two = spark.createDataFrame([("a", "w1 w2"), ("a", "w1 w1 w1 w3"), ("b", "w1")], "docid string, text string")
    c = rankers.Collection(rows(spark, ITEMS, "qid"), two)
    assert c.totals.first()["n"] == 2 and c.tf.where("docid = 'a'").agg({"dl": "max", "docid": "count"}).first()["max(dl)"] in (2, 4)
    assert c.tf.where("docid = 'a' and term = 'w1'").count() == 1


def test_corpus_is_read_once(spark, tmp_path):
    rows(spark, TEXTS, "docid").write.parquet(f"{tmp_path}/docs")
    c = rankers.Collection(rows(spark, ITEMS, "qid"), spark.read.parquet(f"{tmp_path}/docs"))
    plan = rankers.bm25(c)._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/docs" not in plan  # only its written counts are


def test_raw_scores(spark):
    c = rankers.Collection(rows(spark, ITEMS, "qid"), rows(spark, TEXTS, "docid"))
    assert scores(rankers.bm25(c, raw=True)) == pytest.approx(scores(rankers.bm25(c)), abs=1e-9)


@pytest.mark.parametrize("cells", [1, 7, 1 << 21])
def test_nearest_places(monkeypatch, cells):
    monkeypatch.setattr(rankers, "CELLS", cells)
    place = sorted(RNG.sample(range(200), 60))
    word = [RNG.randrange(5) for _ in place]
    import numpy as np

    first, near = rankers._nearest(np.array(place), np.array(word), 5)
    for a in range(5):
        spots = [p for p, w in zip(place, word) if w == a]
        assert first[a] == min(spots)
        for b in range(a):
            assert near[a, b] == min(abs(p - x) for p in spots for x, w in zip(place, word) if w == b)


def test_bm25_does_not_depend_on_the_order_of_sums(spark):
    rows = [("q", "one", x) for x in [0.1] * 10] + [("q", "two", x) for x in [1e5, 0.1, 2.0**-60]] + [("q", "three", 0.0)]
    for n in (1, 3, 7):
        got = {r["docid"]: r["score"] for r in exact.exact_scores(spark.createDataFrame(rows, "qid string, docid string, x double").repartition(n)).collect()}
        assert got == {"one": math.fsum([0.1] * 10), "two": math.fsum([1e5, 0.1, 2.0**-60]), "three": 0.0}


def test_bm25_takes_lengths_times_b_exactly(spark):
    texts = {"a": "zorg " + "word " * 18, "b": "blag " * 4}
    docs = spark.createDataFrame(list(texts.items()), "docid string, text string")
    c = rankers.Collection(spark.createDataFrame([("q", "zorg")], "qid string, text string"), docs)
    (got,) = rankers.bm25(c, 0.9, 0.4, raw=True).collect()
    assert 0.4 * 19 != 7.6  # but in SQL, where 0.4 is a decimal
    assert got["score"] == math.log((2 - 1 + 0.5) / (1 + 0.5) + 1) * 1.9 / (1 + 0.9 * (0.6 + 7.6 / 11.5))
