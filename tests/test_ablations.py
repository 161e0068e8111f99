"""Lattices, held-out decay, controls, strict answers, exact orders and distances against brute force."""

import itertools
import json
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rankloom.functions import exact
from rankloom.operators import bounds, consensus, decay, diagnostics, fusion, lattice, metrics, replay, scope, statistics
from rankloom.plans import ablations  # noqa: F401  registers its queries and those of evidence
from rankloom.plans import queries as Q
from rankloom.sources import strict
from tests.oracle import same

SOURCES = ["a", "b", "c"]


def run_rows(seed=1, queries=3, documents=60, depth=40):
    draw = random.Random(seed)
    out = []
    for q in range(queries):
        for s in SOURCES[: 2 if q == 2 else 3]:  # the last query lacks a list
            own = draw.sample(range(documents), draw.randrange(12, depth))
            score = sorted((round(draw.random() * 9, 3) for _ in own), reverse=True)
            out += [(f"q{q}", s, f"d{x:02d}", i, score[i]) for i, x in enumerate(own)]
    return out


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(run_rows(), "qid string, source string, docid string, rank int, score double").cache()


@pytest.fixture(scope="module")
def qrels(spark):
    draw = random.Random(2)
    return spark.createDataFrame([(f"q{q}", f"d{x:02d}", draw.randrange(4)) for q in range(3) for x in range(60) if draw.random() < 0.6], "qid string, docid string, grade int").cache()


def places(df, *by):
    return {tuple(r[c] for c in (*by, "qid", "docid")): r["rank0"] for r in df.collect()}


def test_lattices_hold_each_ensemble_alone(runs):
    add, ref, chain = lattice.additive(runs, SOURCES).cache(), lattice.regime_aware(runs.where("qid <> 'q2'"), SOURCES).cache(), lattice.markov(runs, SOURCES, pool=20).cache()
    assert {r["mask"] for r in add.select("mask").distinct().collect()} == set(range(1, 8))
    for mask in (2, 5, 7):
        some = [s for i, s in enumerate(SOURCES) if mask >> i & 1]
        own = runs.where(F.col("source").isin(some))
        for name in ("rrf", "z", "anz", "logit"):
            alone = fusion.rrf(own) if name == "rrf" else fusion.comb(own, name)
            assert places(add.where(f"mask = {mask} and fusion = '{name}'")) == places(alone)
        assert places(ref.where(f"mask = {mask}")) == places(consensus.fuse(own.where("qid <> 'q2'"), some, "ref_scoremix"))
        assert places(chain.where(f"mask = {mask}")) == places(fusion.mc4(own, pool=20))


def test_regime_lattice_ranks_all_documents_of_a_query(runs):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE runs(qid VARCHAR, source VARCHAR, docid VARCHAR, rank INT, score DOUBLE)")
    con.executemany("INSERT INTO runs VALUES (?, ?, ?, ?, ?)", run_rows())
    ref = lattice.regime_aware(runs, SOURCES, whole=True).where("qid <> 'q2'").cache()
    for mask in (2, 5, 7):
        some = [s for i, s in enumerate(SOURCES) if mask >> i & 1]
        want = {r[:2]: r[2] for r in con.execute(f"SELECT qid, docid, rank0 FROM ({consensus.fuse_sql(some, 'ref_scoremix')}) WHERE qid <> 'q2'").fetchall()}
        assert places(ref.where(f"mask = {mask}")) == want
        assert len(want) == runs.where("qid <> 'q2'").select("qid", "docid").distinct().count()


def test_at_least_so_many_lists(runs, qrels):
    found = lattice.sweep(lattice.additive(runs, SOURCES, least=2), qrels, ["fusion", "mask"]).collect()
    assert {r["mask"] for r in found} == {3, 5, 6, 7} and all(r["size"] == r["mask"].bit_count() for r in found)


def test_markov_without_rows(spark, runs):
    assert lattice.markov(runs.where("false"), SOURCES).count() == 0


def test_held_out_decay_by_hand(spark, runs, qrels):
    of = spark.createDataFrame([("q0", "x", 0), ("q1", "x", 1), ("q2", "y", 0)], "qid string, collection string, fold int")
    got = places(decay.held_out_fusion(runs, decay.held_out_odds(decay.held_out_counts(runs, qrels, of)), of), "scope")
    grade = {(r["qid"], r["docid"]): r["grade"] for r in qrels.collect()}
    where = {"q0": ("x", 0), "q1": ("x", 1), "q2": ("y", 0)}
    lists = defaultdict(list)
    for q, s, doc, rank, _ in sorted(run_rows(), key=lambda r: r[3]):
        lists[q, s].append(doc)
    want = {}
    for scope_, q in itertools.product(("within", "cross"), where):
        train = [x for x in where if (where[x][0] == where[q][0] and where[x][1] != where[q][1] if scope_ == "within" else where[x][0] != where[q][0])]
        scores = defaultdict(float)
        held = [s for s in SOURCES if (q, s) in lists]
        tables = {}
        for s in held:
            rel, tot = [0] * 100, [0] * 100
            for x in train:
                for k, doc in enumerate(lists.get((x, s), [])):
                    tot[k] += 1
                    rel[k] += grade.get((x, doc), 0) >= 2
            brel, btot = ([sum(v[k // 5 * 5 : k // 5 * 5 + 5]) for k in range(100)] for v in (rel, tot))
            p = (sum(brel) + 1) / (sum(btot) + 2) if sum(btot) else 0.05
            marginal = math.log(p / (1 - p))
            tables[s] = [math.log((r + 1) / (t - r + 1)) if t else marginal for r, t in zip(brel, btot)], marginal
        docs = {doc for s in held for doc in lists[q, s]}
        for doc in docs:
            for s in held:
                f, marginal = tables[s]
                scores[doc] += f[lists[q, s].index(doc)] if doc in lists[q, s] else marginal
        for i, doc in enumerate(sorted(docs, key=lambda x: (-round(scores[x], 8), x))):
            want[scope_, q, doc] = i
    assert got == want


def test_counts_by_subtraction(spark, runs, qrels):
    of = spark.createDataFrame([("q0", "x", 0), ("q1", "x", 1), ("q2", "y", 0)], "qid string, collection string, fold int")
    rows = decay.held_out_counts(runs, qrels, of).collect()
    for r in rows:
        train = [q for q, c, f in (("q0", "x", 0), ("q1", "x", 1), ("q2", "y", 0)) if (c == r["collection"] and f != r["fold"] if r["scope"] == "within" else c != r["collection"])]
        assert r["n"] == sum(q in train and s == r["source"] and rank // 5 == r["bin"] for q, s, _, rank, _ in run_rows())


# controls


def test_control_keeps_its_invariants(runs, qrels):
    drawn = fusion.permutation_control(runs, qrels, 6).cache()
    grade = {(r["qid"], r["docid"]): r["grade"] for r in qrels.collect()}
    natural = {(q, s, doc): rank for q, s, doc, rank, _ in run_rows()}
    held = defaultdict(int)
    for q, s, doc in natural:
        held[q, doc] |= 1 << SOURCES.index(s)
    rows = drawn.collect()
    for r in rows:  # unjudged documents stay
        assert (r["qid"], r["docid"]) in grade or r["rank"] == natural[r["qid"], r["source"], r["docid"]]
    want = defaultdict(Fraction)
    for (q, s, doc), rank in natural.items():
        want[q, s, grade.get((q, doc), -1), held[q, doc]] += Fraction(1, 61 + rank)
    for rep in range(6):
        got = defaultdict(Fraction)
        for r in rows:
            if r["rep"] == rep:
                got[r["qid"], r["source"], grade.get((r["qid"], r["docid"]), -1), held[r["qid"], r["docid"]]] += Fraction(1, 61 + r["rank"])
        assert got == want
    found = replay.invariants(runs, drawn, qrels, SOURCES).collect()
    assert {(r["qid"], r["source"], r["grade"], r["mask"]) for r in found} == set(want)
    assert all(r["replicates"] == r["kept"] == 6 for r in found) and any(r["still"] < 6 for r in found)
    whole = math.lcm(*range(61, 261))
    for r in found:
        assert sum(int(x) * exact.BASE**i for i, x in enumerate(reversed(r["mass"].split(":")))) == whole * want[r["qid"], r["source"], r["grade"], r["mask"]]
    broken = drawn.withColumn("rank", F.when((F.col("rep") == 2) & (F.col("source") == "a"), F.col("rank") + 1).otherwise(F.col("rank")))
    bad = [r for r in replay.invariants(runs, broken, qrels, SOURCES).collect() if r["kept"] < 6]
    assert bad and {r["source"] for r in bad} == {"a"} and all(r["kept"] == 5 for r in bad)


def test_only_named_sources_are_drawn(runs, qrels):
    drawn = fusion.permutation_control(runs, qrels, 2, ["b"]).collect()
    natural = {(q, s, doc): rank for q, s, doc, rank, _ in run_rows()}
    moved = {r["source"] for r in drawn if natural[r["qid"], r["source"], r["docid"]] != r["rank"]}
    assert moved == {"b"}


def test_replay(spark):
    rows = [(g, f"x{i % 4}", i) for g in range(5) for i in range(20)]
    one = spark.createDataFrame(rows, "g int, s string, n int")
    other = [r for r in rows if r != (1, "x2", 2)] + [(2, "x0", 4), (2, "x0", 4), (7, "new", 1)]
    other = [(g, "changed", n) if (g, n) == (3, 5) else (g, s, n) for g, s, n in other]
    random.Random(1).shuffle(other)
    got = {r["g"]: tuple(r)[1:] for r in replay.replay(one, spark.createDataFrame(other, "g int, s string, n int").repartition(7).select("n", "g", "s"), ["g"]).collect()}
    assert got == {0: (20, 20, 0, 0, True), 1: (20, 19, 1, 0, False), 2: (20, 22, 0, 2, False), 3: (20, 20, 1, 1, False), 4: (20, 20, 0, 0, True), 7: (0, 1, 0, 1, False)}
    assert replay.replay(one.where("false"), one.where("false"), ["g"]).count() == 0


# strict answers


def number(text):
    """A JSON number as a fraction; of an exponent of many digits only its sign counts here."""
    mantissa, _, exponent = text.lower().partition("e")
    if len(exponent) < 6:
        return Fraction(text)
    return Fraction(mantissa) * (Fraction(1, 10**9) if exponent[0] == "-" else 10**9)


def code_by_hand(text):
    """The code, and the exact number, by Python's reader; faults in the reader's order of rules."""
    if text is None:
        return "not_text", None
    twice, odd = [], []

    def once(pairs):
        if len(dict(pairs)) < len(pairs):
            twice.append(1)
        return dict(pairs)

    try:
        got = json.loads(text, parse_int=Fraction, parse_float=number, parse_constant=lambda c: odd.append(c) or Fraction(0), object_pairs_hook=once)
    except ValueError:
        return "malformed_json", None
    if odd:
        return "nonfinite", None
    if twice:
        return "duplicate_key", None
    if not isinstance(got, dict):
        return "not_object", None
    if set(got) != {"p_positive"}:
        return "keys", None
    p = got["p_positive"]
    if not isinstance(p, Fraction):
        return "not_number", None
    return (None, p) if 0 <= p <= 1 else ("out_of_range", None)


ANSWERS = [
    None, "", "  ", "0.5", "null", "true", '"x"', "[]", "{}", '{"p_positive": 0.5}', ' { "p_positive" : 1 } ', '{"p_positive":1.0}', '{"p_positive":1.0000000000000000000000000000000000000000000000001}', '{"p_positive":-0}', '{"p_positive":-0.0e5}',
    '{"p_positive":-0.000000000000000000000000000000000000001}', '{"p_positive":1e0}', '{"p_positive":10e-1}', '{"p_positive":11e-1}', '{"p_positive":0.1e1}', '{"p_positive":0.1e2}', '{"p_positive":1e-400}', '{"p_positive":0e999999999999999999999}', '{"p_positive":1e999999999999999999999}', '{"p_positive":1e-999999999999999999999}',
    '{"p_positive":00.5}', '{"p_positive":.5}', '{"p_positive":5.}', '{"p_positive":+0.5}', '{"p_positive":0.5,}', '{"p_positive":0.5} x', '{"p_positive":0.5}{}', "{'p_positive':0.5}", '{p_positive:0.5}', '{"p_positive":0.5', '{"p_positive":NaN}', '{"p_positive":Infinity}', '{"p_positive":-Infinity}', '{"p_positive":nan}', '{"p_positive":[NaN, 1]}', "NaN", "[-Infinity]", '{"p_positive":NaN',
    '{"p_positive":"0.5"}', '{"p_positive":"NaN"}', '{"p_positive":null}', '{"p_positive":true}', '{"p_positive":{}}', '{"p_positive":[0.5]}', '{"p":0.5}', '{"p_positive":0.5,"q":1}', '{"p_positive":0.5,"p_positive":0.5}', '{"q":{"a":1,"a":2}}', '{"p_positive":[{"a":1,"a":2}]}', '[{"a":1,"a":1}]', '{"p\\u005fpositive":0.25}', '{"p_positive": 0.5, "\\"": 1}', '{"":0.5}', '{"p_positive":0.5\n}', '{"p_positive":"a\nb"}', '{"p_positive":"\\x"}', '{"p_positive":"é \\u00e9 \U0001f600"}', "{,}", "[1,,2]", '{"a":}', "{:1}", '{"p_positive":tru}', '{"p_positive":0.5 0.5}', '{"p_positive" 0.5}', "]", '{"NaN":0.5}', "[1 NaN]", "[NaN NaN]", '{"p_positive":--1}', '{"p_positive":1-1}', '"\\ud83d"', "truefalse", "[true,false,null]",
]


def test_probabilities_against_a_plain_reader(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ANSWERS)], "i int, value string")
    got = {r["i"]: (r["code"], r["p"]) for r in strict.parse_probability(df).collect()}
    for i, text in enumerate(ANSWERS):
        code, p = code_by_hand(text)
        assert got[i][0] == code, text
        assert (got[i][1] is None) == (p is None), text
        if p is not None and "999999999999" not in text:
            assert Fraction(got[i][1]) == p
    plan = strict.parse_probability(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_flags(spark):
    lines = {'{"a":true,"b":false}': None, '{"b":false , "a" : true}': None, '{"a":true}': "wrong_id_set", '{"a":true,"b":false,"c":true}': "wrong_id_set", '{"a":true,"b":null}': "not_boolean", '{"a":true,"b":"false"}': "not_boolean", '{"a":1,"b":0}': "not_boolean", '{"a":true,"b":{}}': "not_boolean", "[]": "wrong_id_set", "true": "wrong_id_set", "{": "invalid_json", '{"a":true,"a":true,"b":false}': "duplicate_key", '{"a":NaN,"b":false}': "nonfinite", "": "invalid_json"}
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    got = {r["value"]: (r["code"], r["flags"]) for r in strict.parse_flags(df, F.array(F.lit("b"), F.lit("a"))).collect()}
    assert {k: c for k, (c, _) in got.items()} == {**lines, None: "not_text"}
    assert got['{"b":false , "a" : true}'][1] == {"a": True, "b": False}
    assert {r["code"]: r["n"] for r in strict.violations(strict.parse_flags(df, F.array(F.lit("a"), F.lit("b")))).collect()} == Counter("ok" if c is None else c for c in [*lines.values(), "not_text"])


# exact orders


def test_sums_of_doubles_as_fractions(spark):
    draw = random.Random(4)
    terms = []
    for i in range(60):
        near = [draw.choice([0.1, 0.2, 0.3, 1 / 61, 1 / 62, 1 / 3, 2**-40, 3.0, -0.1]) for _ in range(6)]
        for j in range(3):  # the same numbers in other orders, and one that is a last bit off
            terms += [(f"d{i:02d}{j}", x if j < 2 or k else math.nextafter(x, 9)) for k, x in enumerate(draw.sample(near, 6))]
    df = spark.createDataFrame([("q", d, x) for d, x in terms], "qid string, docid string, x double").repartition(5)
    got = [r["docid"] for r in exact.exact_ranking(df).orderBy("rank0").collect()]
    sums = defaultdict(Fraction)
    for d, x in terms:
        sums[d] += Fraction(x)
    assert got == sorted(sums, key=lambda d: (-sums[d], d))
    one = exact.exact_ranking(df).collect()
    assert all(r["score"] == pytest.approx(float(sums[r["docid"]]), abs=1e-12) for r in one)
    with pytest.raises(Exception):
        exact.exact_ranking(spark.createDataFrame([("q", "d", 2.0**-200)], "qid string, docid string, x double")).collect()


# candidates, distances, places


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_filter_loses_no_candidate(spark, n):
    saved = spark.createDataFrame([(f"q{i % 7}", f"d{i}") for i in range(n)], "qid string, docid string")
    labels = spark.createDataFrame([(f"q{i % 7}", f"d{i}", i % 4) for i in range(6000)], "qid string, docid string, grade int")
    assert {r["docid"] for r in scope.scoped(labels, saved).collect()} == {f"d{i}" for i in range(n)}
    words, bits = scope.bit_filter(saved, ["qid", "docid"])
    through = labels.join(F.broadcast(words), F.lit(True)).where(scope.might_hold(F.col("words"), ["qid", "docid"], bits)).count()
    assert n <= through <= n + 0.1 * 6000


def test_filter_comes_before_the_shuffle(spark):
    saved = spark.createDataFrame([("q", "d")], "qid string, docid string")
    labels = spark.range(1000).selectExpr("'q' as qid", "concat('d', id) as docid", "1 as grade")
    plan = scope.scoped(labels.repartition(3), saved)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("might") < plan.index("Exchange") if "might" in plan else "forall" in plan


def test_scope_ledger(spark):
    saved = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("r", "x")], "qid string, docid string")
    early = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "z", 0)], "qid string, docid string, grade int")
    late = spark.createDataFrame([("q", "a", 2), ("q", "c", 0), ("q", "z", 1), ("q", "y", 1)], "qid string, docid string, grade int")
    got = {r["qid"]: tuple(r)[1:] for r in scope.scope_ledger(saved, early, late).collect()}
    assert got == {"q": (3, 3, 4, 2, 2, 1, 1, 1), "r": (1, 0, 0, 0, 0, 0, 0, 0)}


def test_rank_distance_by_pairs(runs):
    got = {(r["qid"], r["a"], r["b"]): (r["common"], r["discordant"], r["band"]) for r in diagnostics.rank_distance(runs).collect()}
    rank = {(q, s, doc): k for q, s, doc, k, _ in run_rows()}
    for q, (a, b) in itertools.product(("q0", "q1", "q2"), itertools.combinations(SOURCES, 2)):
        both = [doc for x, s, doc in rank if (x, s) == (q, a) and (q, b, doc) in rank]
        n = sum((rank[q, a, x] < rank[q, a, y]) != (rank[q, b, x] < rank[q, b, y]) for x, y in itertools.combinations(both, 2))
        if not both:
            assert (q, a, b) not in got
            continue
        share = n / max(len(both) * (len(both) - 1) / 2, 1)
        assert got[q, a, b] == (len(both), n, "alike" if share < 0.2 else "related" if share < 0.4 else "independent")


def test_mechanism(runs):
    rows = diagnostics.mechanism(runs.where("qid <> 'q2'"), SOURCES).collect()
    for r in rows:
        assert r["mean_pc"] + r["mean_pd"] + r["mean_ps"] == pytest.approx(1, abs=1e-6)
        assert r["verdict"] == ("INERT" if r["max_mod_std"] < 0.003 and r["mean_cross_std"] < 0.003 else "PER-DOC ONLY" if r["mean_cross_std"] < 0.005 else "FULLY ALIVE")
        assert 0 <= r["independence0"] <= 1


def test_ids_with_one_beginning_fill_many_ranges(spark):
    rows = spark.range(5000).selectExpr("format_string('query-%08d', id) as qid", "id as n").repartition(5)
    found = statistics.place(rows)
    assert found.where("i <> n").isEmpty()
    bounds_ = statistics.splitters(rows, "qid", 256)
    assert len(bounds_) > 200 and bounds_ == sorted(bounds_)
    sizes = Counter(sum(f"query-{i:08d}" >= b for b in bounds_) for i in range(5000))
    assert max(sizes.values()) < 150
    assert statistics.place(rows.where("false")).count() == 0


def test_association(spark):
    groups = [("q1", "a", "isolated"), ("q1", "b", "tail_supported"), ("q2", "a", "isolated"), ("q3", "a", "isolated"), ("q3", "b", "tail_supported")]
    of = spark.createDataFrame([("q1", "x"), ("q2", "x"), ("q3", "y")], "qid string, collection string")
    qrels = spark.createDataFrame([("q1", "a", 0), ("q1", "b", 3), ("q3", "a", 0), ("q3", "b", 2)], "qid string, docid string, grade int")
    got = {r["collection"]: r for r in bounds.association(spark.createDataFrame(groups, "qid string, docid string, group string"), qrels, of, ["x", "y"], replicates=50).collect()}
    assert (got["x"]["queries"], got["x"]["eligible"], got["x"]["excluded"]) == (2, 1, "q2") and (got["y"]["excluded"], got["y"]["lower"]) == ("", 1.0)
    assert {r["interpretation"] for r in got.values()} == {"material_positive"} and {r["branch"] for r in got.values()} == {"advance"}


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """Tables of 260 suppliers: 101 and 250 lead one list, which the other lists hold at rank 101 and, beyond their depth of 200, not at all."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("deep"), duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT 1::BIGINT AS p_partkey, 'ONE' AS p_type")
    con.execute("CREATE TABLE supplier AS SELECT s AS s_suppkey, s * 10.0 AS s_acctbal FROM range(1, 261) t(s)")
    con.execute("CREATE TABLE lineitem AS SELECT 1::BIGINT AS l_partkey, s AS l_suppkey, CASE s WHEN 101 THEN 900.0 WHEN 250 THEN 800.0 ELSE 10.0 END AS l_extendedprice, 1.0 AS l_quantity, 'N' AS l_returnflag FROM range(1, 261) t(s)")
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder)


def test_specialist_contrast_reads_lists_to_their_depth(spark, deep):
    same(spark, Q.QUERIES["specialist_contrast"], Q.SQL["specialist_contrast"], deep)
    assert Q.QUERIES["specialist_contrast"](spark, deep).count() == 1


def test_group_contrast_reads_lists_to_their_depth(spark, deep):
    same(spark, Q.QUERIES["group_contrast"], Q.SQL["group_contrast"], deep)
    assert [r["pairs"] for r in Q.QUERIES["group_contrast"](spark, deep).collect()] == [1]
