"""Counts, dense divergences and rankings by hand against the sparse sums and the radix selection."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankloom.llm import divergence as D
from tests.llm.test_operators import LONG

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def by_hand(rows, top=200):
    rows = [((lang or ""), (source or ""), Counter(low(t) for t in TERM.findall(text or ""))) for lang, source, text in rows]
    groups, df, n = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in rows:
        groups[lang].add(source)
        df[lang].update(c.keys())
        n[lang].update(c)
        n[lang, source].update(c)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= 3)

        def share(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q, p = share(n[lang]), {s: share(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def table(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, lang, s, 0, "x", 1, 2) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, term string, value long, rank int").write.parquet(f"{tmp_path}/documents.parquet")
    return D.op13_source_divergence(spark, str(tmp_path))


def drawn(n, seed, words=60):
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("w", "Wort", "é", "日", "ab") for b in ("", "x", "yy", "\U0001f600")] + [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    return [(draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", None, "é", "Z"]), " 1-".join(draw.choices(vocabulary, k=draw.randrange(0, 30)))) for _ in range(n)]


def test_against_dense_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "ENTRIES", 40)  # counts leave a task in many parts
    monkeypatch.setattr(D, "TOP", 7)
    monkeypatch.setattr(D.source_terms, "__defaults__", (7,))
    rows = drawn(300, 1) + [("fr", "only", "un deux"), ("it", "a", None), ("it", "b", ""), ("en", "none", "12 34")]
    assert sorted(tuple(r) for r in table(spark, rows, tmp_path).collect()) == by_hand(rows, 7)


def test_hot_source_and_repeated_rows(spark, tmp_path):
    rows = [("en", "hot", "common words here") for _ in range(400)] + drawn(100, 3) + [("en", "s1", "rare rare rare")] * 3
    assert sorted(tuple(r) for r in table(spark, rows, tmp_path).collect()) == by_hand(rows)


def test_no_rows(spark, tmp_path):
    assert table(spark, [], tmp_path).count() == 0


def test_terms_of_long_texts(monkeypatch):
    text = (LONG + "É日本 A-b \U0001f600x\x00y_z ") * 2
    whole = Counter(low(t).encode() for t in TERM.findall(text))
    assert D.terms(text.encode()) == whole
    for n in (1, 7, 64):
        monkeypatch.setattr(D, "SLICE", n)
        assert D.terms(text[-400:].encode()) == Counter(low(t).encode() for t in TERM.findall(text[-400:]))
    assert D.terms(b"") == Counter()


def select_by_hand(rows, k):
    groups = defaultdict(list)
    for g, v, item in rows:
        groups[g].append((-v, item.encode(), item))
    return sorted((g, item, -v, i + 1) for g, x in groups.items() for i, (v, _, item) in enumerate(sorted(x)[:k]))


@pytest.mark.parametrize(("bits", "k"), [(12, 5), (16, 1), (16, 40)])
def test_radix_select(spark, tmp_path, monkeypatch, bits, k):
    monkeypatch.setattr(D, "BITS", bits)
    draw = random.Random(bits * 100 + k)
    rows = {("wide", draw.randrange(1 << 60), f"i{i}") for i in range(60)}
    rows |= {("ties", draw.randrange(3), f"{'shared prefix ' * draw.randrange(4)}{i}") for i in range(120)}
    rows |= {("one value", 5, "é" * i) for i in range(50)} | {("few", i, "x") for i in range(3)} | {("zero", 0, f"{i:03d}") for i in range(90)}
    rows = sorted(rows)
    path = f"{tmp_path}/rows"
    spark.createDataFrame(rows, "g string, v long, item string").write.parquet(path)
    got = D.radix_select(spark.read.parquet(path), ["g"], "v", "item", k)
    assert sorted(tuple(r) for r in got.collect()) == select_by_hand(rows, k)


def test_radix_select_by_shuffle_with_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "GROUPS", 0)
    rows = [("g", 4, "same")] * 30 + [("g", 4, "sam")] * 2 + [("g", 9, "top")]
    spark.createDataFrame(rows, "g string, v long, item string").write.parquet(f"{tmp_path}/rows")
    got = sorted((r["rank"], r["item"]) for r in D.radix_select(spark.read.parquet(f"{tmp_path}/rows"), ["g"], "v", "item", 5).collect())
    assert got == [(1, "top"), (2, "sam"), (3, "sam"), (4, "same"), (5, "same")]


def test_texts_end_their_terms():
    texts = ["ab", "cd", "", "Ab-ef ", "", " é日 ab ab", "12", "ef"]
    data = [t.encode() for t in texts]
    letters, begins, counts = D.cut(b"".join(data), np.cumsum([len(d) for d in data]))
    assert bytes(letters) == "abcdabefé日ababef".encode() and list(counts) == [1, 1, 0, 2, 0, 3, 0, 1]
    groups = np.array([0, 1, 0, 0, 2, 1, 1, 1])
    group, term, n, df = D.tally(letters, begins, np.repeat(np.arange(8), counts), groups)
    got = sorted(zip(group.tolist(), term.to_pylist(), n.tolist(), df.tolist()))
    assert got == [(0, b"ab", 2, 2), (0, b"ef", 1, 1), (1, b"ab", 2, 1), (1, b"cd", 1, 1), (1, b"ef", 1, 1), (1, "é日".encode(), 1, 1)]
    letters, begins, counts = D.cut(b" 1 ", np.array([0, 3, 3]))
    assert [len(x) for x in D.tally(letters, begins, np.repeat(np.arange(3), counts), np.array([0, 0, 0]))] == [0] * 4


@pytest.mark.parametrize(("piece", "size", "docs"), [(7, 1 << 20, 1 << 20), (100, 50, 1 << 20), (1 << 20, 1 << 20, 3)])
def test_buffers_of_any_size(spark, tmp_path, monkeypatch, piece, size, docs):
    monkeypatch.setattr(D, "SLICE", piece)  # texts beyond it are counted one by one
    monkeypatch.setattr(D, "BYTES", size)
    monkeypatch.setattr(D, "DOCS", docs)
    rows = drawn(150, 5) + [("en", "void", ""), ("xx", "void", None)]
    assert sorted(tuple(r) for r in table(spark, rows, tmp_path).collect()) == by_hand(rows)


def test_one_shuffle_counts(spark, tmp_path, monkeypatch, capsys):
    plans = []

    def written(df, name):
        df.explain("simple")
        plans.append((name, capsys.readouterr().out))
        return df

    monkeypatch.setattr(D, "materialize", written)
    docs = spark.createDataFrame([("en", "a", "b c")], "lang string, source string, text string")
    D.vocabulary(docs)
    assert plans[0][0] == "terms" and plans[0][1].count("Exchange") == 1 and plans[0][1].count("Sort ") == 1


def test_shares_and_sums_beyond_longs(spark):
    for n in (0, 9223372034, 9223372035, 9223372036, 10**12):
        assert spark.sql(f"select cast({n} as bigint) as n, cast(10000000000000 as bigint) as t").selectExpr(D._p("n", "t + 7")).collect()[0][0] == 1 + 10**9 * (n + 1) // (10**13 + 7)
    values = [2 * 10**18] * 9 + [-1, -(2 * 10**18), 5, -(1 << 32)]
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    assert int(rows.selectExpr(D._sum("x")).collect()[0][0]) == sum(values)


@pytest.mark.parametrize("bits", [7, 16])
def test_radix_select_to_the_last_bit(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(D, "BITS", bits)
    monkeypatch.setattr(D, "FEW", 0)
    draw = random.Random(bits)
    rows = {("wide", draw.randrange(1 << 60), f"i{i}") for i in range(60)} | {("near", (1 << 59) + draw.randrange(40), f"n{i}") for i in range(60)} | {("same", 7, f"{i:03d}") for i in range(30)}
    rows |= {("ends", v, str(v)) for e in range(60) for v in ((1 << e) - 1, 1 << e, (1 << e) + 1)}
    rows = sorted(rows)
    spark.createDataFrame(rows, "g string, v long, item string").write.parquet(f"{tmp_path}/rows")
    got = D.radix_select(spark.read.parquet(f"{tmp_path}/rows"), ["g"], "v", "item", 21)
    assert sorted(tuple(r) for r in got.collect()) == select_by_hand(rows, 21)


def test_values_of_all_lengths_take_one_round(spark, tmp_path, monkeypatch):
    rounds = []
    monkeypatch.setattr(D, "materialize", lambda df, name, f=D.materialize: (rounds.append(name), f(df, name))[1])
    rows = [("g", int(2 ** (i / 50)), f"i{i}") for i in range(3000)]
    spark.createDataFrame(rows, "g string, v long, item string").write.parquet(f"{tmp_path}/rows")
    got = D.radix_select(spark.read.parquet(f"{tmp_path}/rows"), ["g"], "v", "item", 1500)
    assert sorted(tuple(r) for r in got.collect()) == select_by_hand(rows, 1500) and len(rounds) == 2
