"""Learned selectors and resampling against plain Python."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import features, statistics
from rankloom.plans import queries as Q
from rankloom.plans import selectors  # noqa: F401  registers its queries
from rankloom.plans import workloads as W


def table(spark, n=40):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(7, i % 4, f"q{i:02d}", *map(float, x[i]), int(y[i]), "ab"[i % 2], float(0.5 + 0.1 * x[i, 1]), float(0.5 + 0.2 * (y[i] - 0.5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "seed int, fold int, qid string, k1 double, k2 double, k3 double, target int, collection string, a double, b double")


def by_hand(x, target, kind, classes, l2):
    """Plain gradient descent until nothing moves any more."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros((len(x[0]) + 1, classes))
    for _ in range(60_000):
        z = x @ w
        if kind == "classes":
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            slope = p - np.eye(classes)[target]
        else:
            p = 1 / (1 + np.exp(-z))
            slope = (p - np.array(target)[:, None]) * (p * (1 - p) if kind == "alpha" else 1)
        g = x.T @ slope / len(x) + l2 * np.r_[w[:-1], np.zeros((1, classes))]
        w -= (4 if kind == "alpha" else 0.5) * g
        if np.abs(g).max() < 1e-10:
            break
    return w


@pytest.mark.parametrize("kind,classes,l2", [("label", 1, 0.1), ("label", 1, 0.01), ("alpha", 1, 0.1), ("classes", 3, 0.1)])
def test_cross_fit(spark, kind, classes, l2):
    rows, df = table(spark)
    if kind == "classes":
        rows = [(*r[:6], (r[6] + (r[4] > 0.5)) % 3, *r[7:]) for r in rows]
        df = spark.createDataFrame(rows, df.schema)
    got = {(r["fold"], r["qid"]): (r["p"], r["held"]) for r in features.cross_fit(df, kind, ("k1", "k2", "k3"), classes, (l2,)).collect()}
    assert len(got) == 4 * 40
    for fold in range(4):
        train = [r for r in rows if r[1] != fold]
        x = np.array([r[3:6] for r in train])
        mean, sd = x.mean(axis=0), x.std(axis=0)
        w = by_hand((x - mean) / sd, [r[6] for r in train], kind, classes, l2)
        for r in rows:
            z = np.r_[(np.array(r[3:6]) - mean) / sd, 1] @ w
            want = 1 / (1 + np.exp(-z)) if kind != "classes" else np.exp(z) / np.exp(z).sum()
            assert got[fold, r[2]] == (pytest.approx(want.tolist(), abs=2e-6), r[1] == fold)


def test_labels_of_one_kind_and_no_rows(spark):
    rows = [(1, i % 2, f"q{i}", float(i), 1) for i in range(8)]
    df = spark.createDataFrame(rows, "seed int, fold int, qid string, k1 double, target int")
    assert all(r["p"][0] > 0.999 for r in features.cross_fit(df, "label", ("k1",)).collect())
    assert features.cross_fit(df.where("false"), "label", ("k1",)).count() == 0


def test_rows_stay_in_their_tasks(spark):
    rows, df = table(spark)
    plan = features.cross_fit(df, "label", ("k1", "k2", "k3"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_curve_loss_climbs(spark):
    rows = [(1, i % 2, f"q{i}", float(i % 3), [0.1, 0.4, 0.9, 0.3]) for i in range(12)]
    df = spark.createDataFrame(rows, "seed int, fold int, qid string, k1 double, target array<double>")
    p = [r["p"][0] for r in features.cross_fit(df, "curve", ("k1",), penalties=(0.001,), passes=40).where("held").collect()]
    assert all(0.6 < x < 0.72 for x in p)  # the peak lies at two thirds


def test_leave_one_out_and_routes(spark):
    rows, df = table(spark)
    got = features.leave_one_out(df, ("k1", "k2", "k3"), (0.01, 1.0), (0.3, 0.5)).collect()
    assert len(got) == 8 and sum(r["best"] for r in got) == 2 and {r["queries"] for r in got} == {20}
    for r in got:
        top = max(x["ndcg"] for x in got if x["collection"] == r["collection"])
        assert not r["best"] or r["ndcg"] == top
    found = spark.createDataFrame([(True, "q", [0.4]), (True, "q", [0.9]), (False, "q", [0.1])], "held boolean, qid string, p array<double>")
    values = spark.createDataFrame([("q", 1.0, 2.0, 4.0)], "qid string, a double, b double, c double")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert features.route_by(found, values, features.two_way(a, b)).first()["chosen"] == 1.5
    assert features.route_by(found, values, features.cascade(a, b, c)).first()["chosen"] == 3.0
    three = spark.createDataFrame([(True, "q", [0.4, 0.4, 0.2])], "held boolean, qid string, p array<double>")
    assert features.route_by(three, values, features.of_classes(a, b, c)).first()["chosen"] == 1.0


def test_curves(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.5], 0.25), ([0.0, 1.0, 0.5], 1.0), ([0.0, 0.0, 0.0], 0.6)], "curve array<double>, at double")
    alphas = [0.0, 0.5, 1.0]
    assert [r[0] for r in df.select(features.on_curve(F.col("curve"), alphas, F.col("at"))).collect()] == pytest.approx([0.5, 0.5, 0.0])
    assert [r[0] for r in df.select(features.soft_target(F.col("curve"), alphas)).collect()] == pytest.approx([1 / 1.5, 1 / 1.5, 0.5])


def test_places_and_bootstrap(spark):
    ids = ["", "a", "ab", "abcdefgh1", "abcdefgh2", "b", "é", "日"] + [f"x{i}" for i in range(50)]
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate(ids)], "qid string, x double").repartition(3)
    for parts in (2, 256):
        assert {r["qid"]: r["i"] for r in statistics.place(df, parts=parts).collect()} == {x: i for i, x in enumerate(sorted(ids, key=lambda t: t.encode()))}
    r = statistics.bootstrap(df, 200).first()
    assert r["n"] == len(ids) and r["low"] < r["mean"] < r["high"]
    one = statistics.bootstrap(df.where("qid = 'a'"), 50).first()
    assert one["low"] == one["mean"] == one["high"]
    folds = {h: {r["qid"]: r["fold"] for r in statistics.folds(df, 5, h).collect()} for h in ("striped", "chunks", "shuffled")}
    assert all(set(f.values()) == set(range(5)) and len(f) == len(ids) for f in folds.values())


def test_bands(spark):
    df = spark.createDataFrame([(0.2, 0.3), (-0.3, -0.2), (-0.04, 0.05), (-0.08, 0.09), (0.05, 0.2)], "l double, u double")
    assert [r[0] for r in df.select(statistics.band(F.col("l"), F.col("u"))).collect()] == ["material_positive", "material_negative", "small_under_chosen_bound", "inconclusive", "inconclusive"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no supplied tables")
@pytest.mark.parametrize("name", ["pqas_selector", "cascade_selector", "class_selector"])
def test_selectors_sum_the_lists_once(spark, monkeypatch, name):
    made = []
    runs = W.runs
    monkeypatch.setattr(W, "runs", lambda *x: made.append(x) or runs(*x))
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert len(made) == 1 and "l_suppkey" not in plan  # neither again for features and fusions nor after the fit
