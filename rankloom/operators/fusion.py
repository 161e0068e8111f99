"""Fusion by one aggregation over long runs(qid, source, docid, rank, score): a list that lacks a document adds nothing, so lists are never joined to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import DIGITS, ranking

K = 60


def rrf(runs: DataFrame, k: float = K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion; weights by source, alike if not given."""
    n = F.size(F.collect_set("source").over(Window.partitionBy("qid")))
    w = 1 / n if weights is None else F.coalesce(*[F.when(F.col("source") == s, F.lit(x)) for s, x in weights.items()])
    return ranking(runs.withColumn("w", w).groupBy("qid", "docid").agg(F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("score")))


#: Fixed grid of smoothing constants.
GRID = (0.5, 1.0, 10.0, 60.0, 200.0, 1000.0)


def k_sweep(runs: DataFrame, grid=GRID) -> DataFrame:
    """RRF for each smoothing constant of a grid, in one pass: k, qid, docid, rank0, score."""
    each = runs.select("qid", "docid", "rank", F.explode(F.array(*map(F.lit, grid))).alias("k"))
    return ranking(each.groupBy("k", "qid", "docid").agg(F.sum(1 / (F.col("k") + F.col("rank"))).alias("score")), ["k", "qid"])


def coverage_proxy(runs: DataFrame) -> DataFrame:
    """By how many lists hold a document, then by its rank sum: qid, docid, rank0, coverage, rank_sum."""
    from rankloom.operators.ranking import rank_within

    sums = runs.groupBy("qid", "docid").agg(F.count(F.lit(1)).alias("coverage"), F.sum(F.col("rank") + 1).alias("rank_sum"))
    return rank_within(sums, ["qid"], [F.desc("coverage"), F.asc("rank_sum"), F.asc("docid")], None, "rank0").select("qid", "docid", "rank0", "coverage", "rank_sum")


def asymptotic_rrf(runs: DataFrame, moments: int = 4) -> DataFrame:
    """RRF's order as k goes to infinity: coverage, then power sums of ranks with alternating signs, exactly in decimals: qid, docid, rank0, coverage."""
    from rankloom.operators.ranking import rank_within

    r = (F.col("rank") + 1).cast("decimal(9,0)")
    power, sums, order = F.lit(1).cast("decimal(9,0)"), [], [F.desc("coverage")]
    for p in range(1, moments + 1):
        power = (power * r).cast("decimal(28,0)")
        sums.append(F.sum(power).alias(f"m{p}"))
        order.append(F.asc(f"m{p}") if p % 2 else F.desc(f"m{p}"))
    rows = runs.groupBy("qid", "docid").agg(F.count(F.lit(1)).alias("coverage"), *sums)
    return rank_within(rows, ["qid"], [*order, F.asc("docid")], None, "rank0").select("qid", "docid", "rank0", "coverage")


def duplicate_quotient(runs: DataFrame, order: list[str]) -> DataFrame:
    """qid, source, kept: of sources whose whole lists are alike the first in order is kept. A list is compared by its documents in order; its depth is bounded by the run's."""
    lists = runs.groupBy("qid", "source").agg(F.sort_array(F.collect_list(F.struct("rank", "docid"))).alias("list"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    first = F.row_number().over(Window.partitionBy("qid", F.transform("list", lambda x: x["docid"])).orderBy(place))
    return lists.select("qid", "source", (first == 1).alias("kept"))


def aggregation_family(runs: DataFrame, k: float = K) -> DataFrame:
    """Seven ways to combine a document's contributions 1 / (k + rank), in one aggregation: op, qid, docid, rank0, score."""
    x = 1 / (k + F.col("rank"))
    n = F.count(F.lit(1))
    rows = runs.groupBy("qid", "docid").agg(
        F.sum(x).alias("sum"),
        F.max(x).alias("max"),
        F.median(x).alias("median"),
        F.exp(F.avg(F.ln(x))).alias("geomean"),
        (F.lit(0.0) - F.sum(F.ln(F.col("rank") + 1))).alias("rank_prod"),
        (n / F.sum(1 / x)).alias("harmonic"),
        (F.sum(x) / F.sqrt(n)).alias("sum_normalized"),
    )
    return ranking(rows.unpivot(["qid", "docid"], ["sum", "max", "median", "geomean", "rank_prod", "harmonic", "sum_normalized"], "op", "score"), ["op", "qid"])


def normalized(runs: DataFrame) -> DataFrame:
    """runs with mm (scores by minimum and maximum of their list; .5 if these are equal) and z (by mean and population deviation; 0 if there is none)."""
    own = Window.partitionBy("qid", "source")
    low, high, sd = F.min("score").over(own), F.max("score").over(own), F.stddev_pop("score").over(own)
    mm = F.when(high - low < 1e-12, 0.5).otherwise((F.col("score") - low) / (high - low))
    z = F.when(sd < 1e-9, 0.0).otherwise((F.col("score") - F.avg("score").over(own)) / sd)
    return runs.withColumn("mm", mm).withColumn("z", z).withColumn("n_sources", F.size(F.collect_set("source").over(Window.partitionBy("qid"))))


def comb(runs: DataFrame, method: str) -> DataFrame:
    """Score fusions: minmax (absent 0), z (absent -2), z_fill0, rectz (positive parts), anz (mean where present), logit (log odds of a squashed z, absent z = -2)."""
    rows = normalized(runs)
    absent = F.max("n_sources") - F.count(F.lit(1))
    clipped = lambda z: F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda z: F.ln(clipped(z) / (1 - clipped(z)))
    score = {
        "minmax": F.sum("mm"),
        "z": F.sum("z") - 2 * absent,
        "z_fill0": F.sum("z"),
        "rectz": F.sum(F.greatest("z", F.lit(0.0))),
        "anz": F.avg("z"),
        "logit": F.sum(logit(F.col("z"))) + absent * logit(F.lit(-2.0)),
    }[method]
    return ranking(rows.groupBy("qid", "docid").agg(score.alias("score")))


def sharpness(runs: DataFrame, at: int = 20) -> DataFrame:
    """qid, source, sharpness: how far the best score is above the at-th, by how far above the upper median, halved into 0..1; .5 for short or flat lists."""
    rows = runs.groupBy("qid", "source").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    n = F.size("s")
    top, low, mid = F.element_at("s", 1), F.element_at("s", F.least(F.lit(at), n)), F.element_at("s", F.floor(n / 2).cast("int") + 1)
    value = F.when((n < at + 1) | (F.abs(top - F.when(n > 0, mid)) < 1e-9), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), (top - low) / F.nullif(top - mid, F.lit(0.0)))) / 2)
    return rows.select("qid", "source", F.round(value, DIGITS).alias("sharpness"))


def sharpness_rrf(runs: DataFrame, k: float = K, temperature: float = 1.0) -> DataFrame:
    """RRF weighted by a softmax of the lists' sharpness."""
    e = F.exp(F.col("sharpness") / max(temperature, 1e-3))
    w = sharpness(runs).select("qid", "source", (e / F.sum(e).over(Window.partitionBy("qid"))).alias("w"))
    return ranking(runs.join(w, ["qid", "source"]).groupBy("qid", "docid").agg(F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("score")))


def empirical_log_odds(runs: DataFrame, qrels: DataFrame, depth: int = 50, width: int = 5, relevant: int = 2) -> DataFrame:
    """source, bin, log_odds, marginal: smoothed log odds of relevance at each bin of ranks of each source."""
    rows = runs.where(F.col("rank") < depth).join(qrels, ["qid", "docid"], "left").select("source", F.floor(F.col("rank") / width).cast("int").alias("bin"), (F.coalesce("grade", F.lit(0)) >= relevant).cast("int").alias("rel"))
    odds = lambda rel, n: F.ln((rel + 1) / (n - rel + 1))
    bins = rows.groupBy("source", "bin").agg(F.sum("rel").alias("rel"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source")
    # every rank of a bin carries the bin's totals, so the marginal counts a bin once for each of its ranks
    return bins.select("source", "bin", F.round(odds(F.col("rel"), F.col("n")), DIGITS).alias("log_odds"), F.round(odds(F.sum(width * F.col("rel")).over(own), F.sum(width * F.col("n")).over(own)), DIGITS).alias("marginal"))


def empirical_fusion(runs: DataFrame, table: DataFrame, depth: int = 50, width: int = 5, missing: str = "marginal") -> DataFrame:
    """Sum of each list's log odds at a document's rank; where a list lacks the document its marginal (marginal), its odds at the deepest bin (tail), or nothing (zero). A bin without data has the marginal."""
    last = (depth - 1) // width
    absent = {"marginal": F.max("marginal"), "tail": F.coalesce(F.max(F.when(F.col("bin") == last, F.col("log_odds"))), F.max("marginal")), "zero": F.lit(0.0)}[missing]
    of_list = table.groupBy("source").agg(absent.alias("absent"))
    every = of_list.agg(F.sum("absent").alias("all_absent"))
    rows = runs.where(F.col("rank") < depth).withColumn("bin", F.floor(F.col("rank") / width).cast("int")).join(F.broadcast(table), ["source", "bin"]).join(F.broadcast(of_list), "source")  # bins of sources, parameters both
    return ranking(rows.groupBy("qid", "docid").agg(F.sum(F.col("log_odds") - F.col("absent")).alias("x")).join(F.broadcast(every), F.lit(True)).select("qid", "docid", (F.col("x") + F.col("all_absent")).alias("score")))


def decay_curve(table: DataFrame, k: float = K, depth: int = 50, width: int = 5) -> DataFrame:
    """source, rank, learned (log odds at the rank) and reciprocal (1 / (k + rank)): the learned decay beside the fixed one."""
    ranks = table.sparkSession.range(depth).select(F.col("id").cast("int").alias("rank"))
    return ranks.withColumn("bin", F.floor(F.col("rank") / width).cast("int")).join(F.broadcast(table), "bin").select("source", "rank", F.col("log_odds").alias("learned"), F.round(1 / (k + F.col("rank")), DIGITS).alias("reciprocal"))


def modulated(scores: DataFrame, other: DataFrame, alphas: list[float]) -> DataFrame:
    """scores(qid, docid, rank0, score), a fusion, moved towards the places of other(qid, docid, rank0), by how much alphas say: a document that the other puts higher gains a tenth of the log of the places, one that it puts lower loses a twentieth. alpha, qid, docid, rank0, score; a document that the other lacks has its place 1000."""
    both = scores.select("qid", "docid", F.col("rank0").alias("a"), F.col("score").alias("x")).join(other.select("qid", "docid", F.col("rank0").alias("b")), ["qid", "docid"], "left")
    delta = F.col("a") - F.coalesce("b", F.lit(1000))
    step = F.when(delta > 0, F.log1p(delta) * 0.10).otherwise(-F.log1p(-delta) * 0.05)
    each = both.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    return ranking(each.select("alpha", "qid", "docid", (F.col("x") * (1 + F.col("alpha") * step)).alias("score")), ["alpha", "qid"])


def positional_mix(first: DataFrame, second: DataFrame, share: float = 0.5) -> DataFrame:
    """Two rankings(qid, docid, rank0) mixed by 1 / (place + 1), share of it the second's; absent is 0."""
    a = first.select("qid", "docid", F.col("rank0").alias("a"))
    both = a.join(second.select("qid", "docid", F.col("rank0").alias("b")), ["qid", "docid"], "full")
    part = lambda c: F.coalesce(1 / (F.col(c) + 1), F.lit(0.0))
    return ranking(both.select("qid", "docid", ((1 - share) * part("a") + share * part("b")).alias("score")))


#: Fixed weights of the gates: coverage, dispersion, lift, entropy, bias.
GATES = {3: (1.8, 1.2, 1.3, 0.0, -1.2), 4: (1.5, 1.0, 1.2, 0.6, -1.0)}


def gate_signals(runs: DataFrame, consensus: DataFrame, specialist: DataFrame, n_sources: int, k: float = K, depth: int = 200) -> DataFrame:
    """qid, docid, cov (share of lists), disp (spread of ranks), lift (places by which the specialist ranking puts it higher, over depth), ent (entropy of its reciprocal ranks over lists, 0 to 1). consensus and specialist: rankings(qid, docid, rank0)."""
    p = 1 / (k + F.col("rank") + 1)
    rows = runs.groupBy("qid", "docid").agg(F.count(F.lit(1)).alias("c"), F.avg("rank").alias("mu"), F.stddev_pop("rank").alias("sd"), F.sum(p).alias("sp"), F.sum(p * F.ln(p)).alias("spl"))
    total = F.col("sp") + 1e-12
    place = lambda df, name: df.select("qid", "docid", F.col("rank0").alias(name))
    rows = rows.join(place(consensus, "cr"), ["qid", "docid"], "left").join(place(specialist, "sr"), ["qid", "docid"], "left")
    lift = F.greatest(F.lit(0.0), (F.coalesce("cr", F.lit(depth)) - F.coalesce("sr", F.lit(depth))) / depth)
    entropy = -(F.col("spl") - F.col("sp") * F.ln(total)) / total
    import math

    return rows.select("qid", "docid", (F.col("c") / n_sources).alias("cov"), F.when(F.col("c") >= 2, F.col("sd") / (F.col("mu") + k)).otherwise(0.0).alias("disp"), lift.alias("lift"), (entropy / (math.log(n_sources) + 1e-12)).alias("ent"))


def gates(signals: DataFrame, regimes: DataFrame, low: float = 0.05, high: float = 0.60, power: float = 1.5) -> DataFrame:
    """signals and regimes(qid, tq) to qid, docid, gate3, gate4: how much a document listens to the specialists, from low up to a share of high that grows with the disagreement tq."""
    top = low + (high - low) * F.pow(F.col("tq"), F.lit(power))
    rows = signals.join(regimes.select("qid", "tq"), "qid")

    def gate(n: int):
        a, b, c, e, bias = GATES[n]
        g = a * (1 - F.col("cov")) + b * F.col("disp") + c * F.col("lift") + e * (1 - F.col("ent")) + bias
        return F.round(low + (top - low) / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), g)))), 9)

    return rows.select("qid", "docid", gate(3).alias("gate3"), gate(4).alias("gate4"))


def guarded(gate: DataFrame, specialist: DataFrame, column: str, low: float = 0.05, least: float = 1e-6) -> DataFrame:
    """gate with column set to low where specialist(qid, docid, score) is below least or lacks the document."""
    rows = gate.join(specialist.select("qid", "docid", F.col("score").alias("s_")), ["qid", "docid"], "left")
    return rows.withColumn(column, F.when(F.coalesce("s_", F.lit(0.0)) < least, low).otherwise(F.col(column))).drop("s_")


def decomposition(runs: DataFrame, base: str, variants: list[str], other: str, k: int = K) -> DataFrame:
    """The difference between the mean of base and its variants plus other, and base plus other: qid, docid, variant, category (shared, arrival, departure or absent, by who holds the document), num and den of the variant's part of it, an exact fraction."""
    ranks = runs.where(F.col("source").isin([base, *variants, other])).groupBy("qid", "docid").agg(*[F.max(F.when(F.col("source") == s, F.col("rank") + 1)).cast("bigint").alias(f"r{i}") for i, s in enumerate([base, *variants])])
    parts = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"r{i}").alias("v")) for i, v in enumerate(variants, 1)])
    rows = ranks.select("qid", "docid", F.col("r0").alias("a"), F.inline(parts))
    a, v = F.col("a"), F.col("v")
    category = F.when(a.isNotNull() & v.isNotNull(), "shared").when(v.isNotNull(), "arrival").when(a.isNotNull(), "departure").otherwise("absent")
    m = len(variants) + 1
    num = F.when(category == "shared", a - v).when(category == "arrival", 1).when(category == "departure", -1).otherwise(0).cast("bigint")
    den = F.when(category == "shared", m * (k + a) * (k + v)).when(category == "arrival", m * (k + v)).when(category == "departure", m * (k + a)).otherwise(1).cast("bigint")
    return rows.select("qid", "docid", "variant", category.alias("category"), num.alias("num"), den.alias("den"))


def preferences(ranks):
    """Of one list's ranks (nan where it lacks a document), by documents: both are held, and the second stands above the first."""
    import numpy as np

    have = ~np.isnan(ranks)
    return np.outer(have, have).astype(float), (np.nan_to_num(ranks, nan=np.inf)[None, :] < np.nan_to_num(ranks, nan=-np.inf)[:, None]).astype(float)


def stationary(both, above, damping: float, iterations: int, tolerance: float):
    """Where the chain stays that moves from a document to one that most lists holding both put above it."""
    import numpy as np

    n = len(both)
    move = (2 * above > both) & (both > 0)
    step = (1 - damping) / n * move
    np.fill_diagonal(step, (1 - damping) * (1 - move.sum(axis=1) / n))
    pi = np.full(n, 1 / n)
    for _ in range(iterations):
        new = damping / n + pi @ step
        new /= new.sum()
        done = np.abs(new - pi).sum() < tolerance
        pi = new
        if done:
            break
    return pi


def mc4(runs: DataFrame, pool: int = 100, damping: float = 0.15, iterations: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """Markov chain fusion: from a document to one that most lists holding both put above it. A query's pool is bounded by pool times the number of lists, so each query is one small matrix: qid, docid, rank0, score."""
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="docid", columns="source", values="rank")
        wide = wide[(wide < pool).any(axis=1)].sort_index()
        both, above = map(sum, zip(*(preferences(r) for r in wide.to_numpy(float).T)))
        return pd.DataFrame({"qid": rows["qid"].iloc[0], "docid": wide.index, "score": stationary(both, above, damping, iterations, tolerance)})

    return ranking(runs.select("qid", "source", "docid", "rank").groupBy("qid").applyInPandas(one, "qid string, docid string, score double"))


def ensembles(runs: DataFrame, arms: DataFrame, k: float = K) -> DataFrame:
    """RRF of several ensembles at once: arms(arm, source[, copies]) to arm, qid, docid, rank0, score; a source may count several times. Arms are a parameter, a few rows."""
    copies = F.col("copies") if "copies" in arms.columns else F.lit(1)
    rows = runs.join(F.broadcast(arms), "source")
    return ranking(rows.groupBy("arm", "qid", "docid").agg(F.sum(copies / (k + F.col("rank") + 1)).alias("score")), ["arm", "qid"])


def permutation_control(runs: DataFrame, qrels: DataFrame, replicates: int = 256, sources: list[str] | None = None) -> DataFrame:
    """rep, qid, source, docid, rank: lists in which documents of one grade that the same lists hold have changed places; unjudged documents, and lists that sources leaves out, stay as they are. Draws come from a digest of replicate and document, so they are the same on every engine."""
    own = Window.partitionBy("qid", "source", "grade", "mask", "fixed")
    held = Window.partitionBy("qid", "docid")
    rows = runs.join(qrels, ["qid", "docid"], "left").withColumn("mask", F.array_join(F.sort_array(F.collect_set("source").over(held)), ","))
    still = F.col("grade").isNull() if sources is None else F.col("grade").isNull() | ~F.col("source").isin(sources)
    rows = rows.withColumn("fixed", F.when(still, F.col("docid")).otherwise("")).withColumn("grade", F.coalesce("grade", F.lit(-1))).withColumn("place", F.row_number().over(own.orderBy("rank")))
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    mine = Window.partitionBy("rep", "qid", "source", "grade", "mask", "fixed").orderBy(F.md5(F.concat_ws(":", "rep", "docid")), "docid")
    drawn = each.select("rep", "qid", "source", "grade", "mask", "fixed", "docid", F.row_number().over(mine).alias("place"))
    keys = ["qid", "source", "grade", "mask", "fixed", "place"]
    return drawn.join(rows.select(*keys, "rank"), keys).select("rep", "qid", "source", "docid", "rank")


def demo_runs(spark, queries: int = 50, documents: int = 500, rankers: int = 4, depth: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Synthetic runs and judgments: grades 0..3 by a power law, and rankers that see them through more or less noise."""
    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    base = spark.range(queries).select(F.format_string("q%03d", "id").alias("qid")).join(spark.range(documents).select(F.format_string("d%05d", "id").alias("docid")), F.lit(True))
    graded = base.withColumn("grade", F.floor(4 * F.pow(unit("qid", "docid"), F.lit(6.0))).cast("int"))
    each = graded.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rankers))))
    scored = each.select("qid", F.format_string("ranker%d", "r").alias("source"), "docid", F.round(F.col("grade") + F.col("r") * unit("qid", "docid", "r"), 6).alias("score"))
    from rankloom.operators.ranking import rank_within

    return rank_within(scored, ["qid", "source"], [F.desc("score"), F.asc("docid")], depth).select("qid", "source", "docid", "rank", "score"), graded.select("qid", "docid", "grade")


#: How each scenario's lists differ from the order of relevance: shift of scores by noise, and which lists follow whom.
SCENARIOS = ("moderate", "specialist_outlier", "cabal", "agreement", "disagreement", "noisy_independent", "score_aware")


def scenario_runs(spark, documents: int = 200, rankers: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Synthetic runs and judgments of named scenarios, one query each (qid is the name): lists with moderate noise; one list of its own against alike ones; a cabal of three copies; all alike; all in unlike orders; much noise of each list's own; and noise that shrinks with relevance. Draws are hashes, alike on every machine."""
    from rankloom.operators.ranking import rank_within

    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    names = spark.createDataFrame([(s,) for s in SCENARIOS], "qid string")
    base = names.join(spark.range(documents).select(F.format_string("d%05d", "id").alias("docid")), F.lit(True))
    graded = base.withColumn("grade", F.floor(4 * F.pow(unit("qid", "docid"), F.lit(6.0))).cast("int"))
    each = graded.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rankers))))
    own, common = unit("qid", "docid", "r"), unit("qid", "docid", F.lit("common"))
    r, q = F.col("r"), F.col("qid")
    score = (
        F.when(q == "agreement", F.col("grade") + common)
        .when(q == "disagreement", own)
        .when(q == "cabal", F.when(r <= 3, 4 * unit("qid", "docid", F.lit("cabal"))).otherwise(F.col("grade") + own))
        .when(q == "specialist_outlier", F.when(r == rankers, F.col("grade") + 0.2 * own).otherwise(2 * common + 0.2 * own))
        .when(q == "noisy_independent", F.col("grade") + 6 * own)
        .when(q == "score_aware", F.col("grade") + 3 * own / (1 + F.col("grade")))
        .otherwise(F.col("grade") + 2 * own)
    )
    scored = each.select("qid", F.format_string("ranker%d", "r").alias("source"), "docid", F.round(score, 6).alias("score"))
    return rank_within(scored, ["qid", "source"], [F.desc("score"), F.asc("docid")]).select("qid", "source", "docid", "rank", "score"), graded.select("qid", "docid", "grade")
