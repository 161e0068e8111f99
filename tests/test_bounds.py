"""Bounds against every completion of the missing judgments."""

import itertools
import random
from fractions import Fraction

import pytest

from rankloom.operators import bounds, labs, statistics

RANK, REL = "qid string, docid string, rank0 int", "qid string, docid string, grade int"


def frames(spark, lists, grades):
    made = [spark.createDataFrame([("q", d, i) for i, d in enumerate(x)], RANK) for x in lists]
    return *made, spark.createDataFrame([("q", d, g) for d, g in grades.items()], REL)


def test_rbp_against_completions(spark):
    rng = random.Random(6)
    for _ in range(6):
        docs = [f"d{i}" for i in range(5)]
        a, b = rng.sample(docs, 4), rng.sample(docs, 4)
        grades = {d: rng.randint(0, 3) for d in rng.sample(docs, 3)}
        gain = lambda ds, full: sum(Fraction(4**i * 5 ** (9 - i)) * full[d] for i, d in enumerate(ds))
        missing = sorted(set(a + b) - set(grades))
        values = [gain(b, full) - gain(a, full) for xs in itertools.product(range(4), repeat=len(missing)) if (full := {**grades, **dict(zip(missing, xs))})]
        got = bounds.rbp_bounds(*frames(spark, (a, b), grades)).first()
        assert (got["lower"], got["upper"], got["unknown"]) == (min(values), max(values), len(missing))


def test_p10_and_teams_against_completions(spark):
    rng = random.Random(7)
    docs = [f"d{i}" for i in range(8)]
    teams = {"t": ["a", "b"], "u": ["b", "c", "d"]}
    lists = {s: rng.sample(docs, 4) for s in "abcd"}
    fused = {t: rng.sample(docs, 4) for t in teams}
    grades = {d: rng.randint(0, 2) for d in docs[:5]}
    heads = spark.createDataFrame([(t, s, "q", d) for t, ss in teams.items() for s in ss for d in lists[s]], "team string, source string, qid string, docid string")
    of_teams = spark.createDataFrame([(t, "q", d) for t, ds in fused.items() for d in ds], "team string, qid string, docid string")
    rel = spark.createDataFrame([("q", d, g) for d, g in grades.items()], REL)
    got = bounds.team_bounds(heads, of_teams, rel, []).first()
    missing = docs[5:]
    values = []
    for xs in itertools.product((0, 1), repeat=len(missing)):
        full = {**{d: int(g > 0) for d, g in grades.items()}, **dict(zip(missing, xs))}
        values.append(sum(6 * sum(full[d] for d in fused[t]) - 6 // len(ss) * sum(full[d] for s in ss for d in lists[s]) for t, ss in teams.items()))
    assert (got["lower"], got["upper"]) == (min(values), max(values))
    a, b, rel = frames(spark, (fused["t"], fused["u"]), grades)
    row = bounds.p10_bounds(a, b, rel).first()
    diff = [sum((g > 0) * ((d in fused["t"]) - (d in fused["u"])) for d, g in {**grades, **dict(zip(missing, xs))}.items()) for xs in itertools.product((0, 1), repeat=3)]
    assert (row["lower"], row["upper"]) == (min(diff), max(diff))


def test_acquisition(spark):
    a, b = [f"d{i}" for i in range(10)], [f"d{i}" for i in range(9, -1, -1)]
    rows = {r["budget"]: r for r in bounds.acquisition_plan(*frames(spark, (a, b), {"d0": 1})).collect()}
    w = [4**i * 5 ** (9 - i) for i in range(10)]
    size = {f"d{i}": abs(w[9 - i] - w[i]) for i in range(1, 10)}
    assert rows[0]["by_influence"] == rows[0]["by_head"] == sum(size.values())
    assert rows[3]["by_influence"] == sum(sorted(size.values())[:-3])
    assert all(r["by_influence"] <= r["by_head"] <= r["width"] for r in rows.values())


def test_exchange(spark):
    major, special = [f"m{i}" for i in range(10)], ["m0", "s1", *[f"m{i}" for i in range(1, 9)]]
    a, s, rel = frames(spark, (major, special), {"s1": 2, "m9": 0})
    row = bounds.exchange_ledger(bounds.minority_exchange(a, s, a), rel).first()
    assert (row["admitted"], row["displaced"], row["category"]) == ("s1", "m9", "rescue")


def test_scalar_interval(spark):
    rng = random.Random(11)
    kind = "qid string, docid string, x bigint"
    for case in range(8):
        docs = [f"d{i:02}" for i in range(14)]
        a, s = ({d: rng.randint(0, 6) for d in rng.sample(docs, 11)} for _ in range(2))
        universe = sorted(set(a) | set(s))
        w0 = Fraction(rng.randint(0, 8), rng.randint(1, 4))
        top = lambda w: set(sorted(universe, key=lambda d: (-(w * a.get(d, 0) + s.get(d, 0)), d))[:10])
        head = top(w0) if case % 4 else set(rng.sample(universe, 10))
        got = bounds.scalar_interval(spark.createDataFrame([("q", d) for d in head], "qid string, docid string"), *[spark.createDataFrame([("q", d, v) for d, v in x.items()], kind) for x in (a, s)]).first()
        grid = [Fraction(i, 24) for i in range(24 * 12)]
        fits = [w for w in grid if top(w) == head]
        if got is None:
            continue
        assert got["feasible"] or not fits
        if got["feasible"]:
            low = Fraction(got["lower_num"], got["lower_den"])
            high = None if got["upper_num"] is None else Fraction(got["upper_num"], got["upper_den"])
            inside = [w for w in grid if (w > low or w == low and not got["lower_strict"]) and (high is None or w < high or w == high and not got["upper_strict"])]
            assert inside == fits
            for end, who in ((low, "lower"), (high, "upper")):
                if got[f"{who}_head"]:  # the pair that sets an end is equal there
                    x, y = got[f"{who}_head"], got[f"{who}_excluded"]
                    assert end * a.get(x, 0) + s.get(x, 0) == end * a.get(y, 0) + s.get(y, 0)


def test_common_interval(spark):
    kind = "qid string, lower_num bigint, lower_den bigint, lower_strict boolean, upper_num bigint, upper_den bigint, upper_strict boolean, feasible boolean"
    one = lambda *rows: bounds.common_interval(spark.createDataFrame(rows, kind)).first()
    a, b = ("a", 1, 3, False, 2, 1, False, True), ("b", 2, 6, True, 3, 2, False, True)
    got = one(a, b, ("c", 0, 1, False, None, None, None, True))
    assert (got["reason"], got["lower_qid"], got["lower_strict"], got["upper_qid"]) == ("feasible", "b", True, "b")
    assert one(a, ("b", 5, 2, False, None, None, None, True))["reason"] == "empty_common"
    assert one(a, ("b", 2, 1, False, None, None, None, True))["reason"] == "feasible"
    assert one(a, ("b", 2, 1, True, None, None, None, True))["reason"] == "empty_common"
    assert one(a, ("b", 0, 1, False, None, None, None, False))["reason"] == "query_infeasible"


def test_published_laboratory_values(spark):
    rows = {(r["specialist"], r["arm"], r["policy"]): r for r in labs.losses(labs.policies(labs.packets(labs.worlds(spark)))).collect()}
    best = rows["weak", "all", "blind_bayes"]
    assert abs(best["brier"] - 0.195518) < 1e-6 and abs(best["error"] - 0.272) < 1e-9


def test_trace(spark):
    rows = [(r["step"], r["a"], r["b"], r["result"]) for r in labs.trace(spark, [("p", -3, 4, 2)]).orderBy("step").collect()]
    assert rows == [(0, -3, 4, None), (1, 1, -3, None), (2, -2, 1, False)]
    with pytest.raises(Exception, match="more than 64 rounds"):
        labs.trace(spark, [("p", 1, 1, 3), ("x", 1, 1, 65)]).collect()


def test_votes_and_verifiers(spark):
    answers = spark.createDataFrame([("p", "a", True, 1.0), ("p", "b", False, 3.0), ("p", "c", True, 1.0), ("q", "a", True, 1.0), ("q", "b", None, 9.0), ("r", "a", None, 1.0), ("s", "a", True, 1.0), ("s", "b", False, 1.0)], "program string, voter string, answer boolean, weight double")
    got = {r["program"]: (r["majority"], r["weighted"], r["unanimous"]) for r in labs.votes(answers).collect()}
    assert got == {"p": (True, False, None), "q": (True, True, True), "r": (None, None, None), "s": (None, None, None)}
    seen = spark.createDataFrame([("v", "p", True, True), ("v", "q", False, True), ("v", "r", True, None), ("v", "s", True, False)], "verifier string, program string, valid boolean, accepted boolean")
    assert tuple(labs.verifier_scores(seen).first()) == ("v", 4, 3, 0.25, 1, 1)
    roots = labs.root_order(spark.createDataFrame([("x", i, v) for i, v in enumerate("babc")], "id string, place int, label string"))
    assert [r["root"] for r in roots.orderBy("place").collect()] == [0, 1, 0, 2]


def test_statistics(spark):
    import math

    values = spark.createDataFrame([("p", float(i % 5), float(i % 3)) for i in range(30)] + [("same", 1.0, 1.0)] * 3 + [("one", 1.0, 0.0)], "pair string, a double, b double")
    got = {r["pair"]: r for r in statistics.paired_t(values).collect()}
    d = [i % 5 - i % 3 for i in range(30)]
    m = sum(d) / 30
    t = m / math.sqrt(sum((x - m) ** 2 for x in d) / 29 / 30)
    assert abs(got["p"]["t"] - t) < 1e-5 and abs(got["p"]["p"] - math.erfc(abs(t) / math.sqrt(2))) < 1e-5
    assert got["same"]["t"] == 0 and (got["one"]["t"], got["one"]["p"]) == (0.0, 1.0)
