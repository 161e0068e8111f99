"""A finite-probability laboratory: who should be believed when reports may be copies. All 32 worlds are enumerated; weights are integers over WEIGHT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accuracies in tenths and twentieths: of generalists, and of the weak and the strong specialist.
GENERALIST, SPECIALISTS = 7, {"weak": 11, "strong": 17}
WEIGHT = 2 * 10**3 * 20


def worlds(spark: SparkSession) -> DataFrame:
    """specialist, y, g1, g2, g3, s, ps (twentieths), w."""
    signs = lambda name: spark.createDataFrame([(-1,), (1,)], f"{name} int")
    rows = spark.createDataFrame(sorted(SPECIALISTS.items()), "specialist string, ps int")
    for name in ("y", "g1", "g2", "g3", "s"):
        rows = rows.join(F.broadcast(signs(name)), F.lit(True))
    hit = lambda c, p, n: F.when(F.col(c) == F.col("y"), p).otherwise(n - p)
    return rows.withColumn("w", (hit("g1", F.lit(GENERALIST), 10) * hit("g2", F.lit(GENERALIST), 10) * hit("g3", F.lit(GENERALIST), 10) * hit("s", F.col("ps"), 20)).cast("bigint"))


def packets(rows: DataFrame) -> DataFrame:
    """Each world in three arms: padded (one generalist's report and blanks), copied (thrice the same report) and independent; a, b, c are the generalists' reports and roots how many of them are their own."""
    null = F.lit(None).cast("int")
    arms = F.array(
        F.struct(F.lit("padded").alias("arm"), F.col("g1").alias("a"), null.alias("b"), null.alias("c"), F.lit(1).alias("roots")),
        F.struct(F.lit("copied").alias("arm"), F.col("g1").alias("a"), F.col("g1").alias("b"), F.col("g1").alias("c"), F.lit(1).alias("roots")),
        F.struct(F.lit("independent").alias("arm"), F.col("g1").alias("a"), F.col("g2").alias("b"), F.col("g3").alias("c"), F.lit(3).alias("roots")),
    )
    return rows.select("specialist", "ps", "y", "s", "w", F.inline(arms))


def _likelihood(up, down, s, ps):
    """Posterior from how many generalists say yes and no, and the specialist."""
    pg, p = GENERALIST / 10, ps / 20
    yes = F.pow(F.lit(pg), up) * F.pow(F.lit(1 - pg), down) * F.when(s == 1, p).otherwise(1 - p)
    no = F.pow(F.lit(1 - pg), up) * F.pow(F.lit(pg), down) * F.when(s == 1, 1 - p).otherwise(p)
    return yes / (yes + no)


def policies(rows: DataFrame) -> DataFrame:
    """packets to specialist, arm, y, w, policy, p: what each policy believes."""
    key = ["specialist", "s", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("c", F.lit(0)).alias("c")]
    rows = rows.select("ps", "y", "w", "arm", "roots", *key)
    blind = rows.groupBy("specialist", "s", "a", "b", "c").agg((F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(F.lit(0).cast("bigint"))) / F.sum("w")).alias("blind"))
    rows = rows.join(blind, ["specialist", "s", "a", "b", "c"])
    n = lambda v: sum(((F.col(c) == v).cast("int") for c in "abc"), F.lit(0))
    any_ = lambda v: ((F.col("a") == v) | (F.col("b") == v) | (F.col("c") == v)).cast("int")
    root = lambda v: F.when(F.col("roots") == 1, (F.col("a") == v).cast("int")).otherwise(n(v))
    s, ps = F.col("s"), F.col("ps")
    against = (F.col("a") == -s) & (F.col("b") == -s) & (F.col("c") == -s)
    said = {
        "naive": _likelihood(n(1), n(-1), s, ps),
        "payload_quotient": _likelihood(any_(1), any_(-1), s, ps),
        "blind_bayes": F.col("blind"),
        "equal_root": (root(1) + (s == 1).cast("int")) / (F.col("roots") + 1),
        "aware_bayes": _likelihood(root(1), root(-1), s, ps),
        "protected_minority": F.when(against, F.when(s == 1, ps / 20).otherwise(1 - ps / 20)).otherwise(F.col("blind")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("policy"), v.cast("double").alias("p")) for k, v in said.items()])
    return rows.select("specialist", "arm", "y", "w", "s", "a", "b", "c", F.inline(each))


def _brier(p, w, positive):
    """Expected squared error of a belief p, over weight w of which positive is true."""
    return positive * F.pow(1 - p, F.lit(2)) + (w - positive) * F.pow(p, F.lit(2))


def losses(believed: DataFrame) -> DataFrame:
    """specialist, arm (all: the three alike), policy, brier, error, excess (brier less that of the policy that knows the roots), correction and harm (how often the policy is right where blind_bayes is wrong, and the other way round); a belief of one half errs half the time."""
    arms = believed.select("specialist", F.explode(F.array("arm", F.lit("all"))).alias("arm"), "y", "w", "s", "a", "b", "c", "policy", F.round("p", 12).alias("p"))
    truth = (F.col("y") == 1).cast("double")
    error = lambda p: F.when(p == 0.5, 0.5).otherwise(((p > 0.5).cast("double") != truth).cast("double"))
    same = Window.partitionBy("specialist", "arm", "y", "w", "s", "a", "b", "c")
    base = lambda name: F.max(F.when(F.col("policy") == name, F.col("p"))).over(same)
    rows = arms.withColumn("blind", error(base("blind_bayes"))).withColumn("own", error(F.col("p")))
    mean = lambda x: F.round(F.sum(F.col("w") * x) / F.sum("w"), 9)
    out = rows.groupBy("specialist", "arm", "policy").agg(mean(F.pow(F.col("p") - truth, F.lit(2))).alias("brier"), mean(F.col("own")).alias("error"), mean((1 - F.col("own")) * F.col("blind")).alias("correction"), mean(F.col("own") * (1 - F.col("blind"))).alias("harm"))
    aware = F.max(F.when(F.col("policy") == "aware_bayes", F.col("brier"))).over(Window.partitionBy("specialist", "arm"))
    return out.withColumn("excess", F.round(F.col("brier") - aware, 9) + 0.0)


def packet_pairs(spark: SparkSession) -> DataFrame:
    """specialist, arm, s, a, b, c, w (mass), positive (of it, true), aware and blind: the posteriors of who knows the arm and of who doesn't. One row for each packet that can arrive."""
    rows = packets(worlds(spark)).fillna(0, ["b", "c"])
    mass = [F.sum("w").alias("w"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(F.lit(0).cast("bigint"))).alias("positive")]
    aware = rows.groupBy("specialist", "arm", "s", "a", "b", "c").agg(*mass)
    blind = rows.groupBy("specialist", "s", "a", "b", "c").agg(*mass).select("specialist", "s", "a", "b", "c", (F.col("positive") / F.col("w")).alias("blind"))
    return aware.join(blind, ["specialist", "s", "a", "b", "c"]).withColumn("aware", F.col("positive") / F.col("w"))


def decompose(pairs: DataFrame, predicted: DataFrame) -> DataFrame:
    """packet_pairs and predicted(specialist, arm, s, a, b, c, p_aware, p_blind), what somebody believes, to specialist, pairs, valid, coverage (share of mass predicted), aware_brier, blind_brier, gap (the first less the second) and its parts: information (the ideal gap), regret (squared distances from the ideal) and selection. gap = information + regret + selection; the last is 0 when all pairs are predicted."""
    keys = ["specialist", "arm", "s", "a", "b", "c"]
    rows = pairs.join(predicted, keys, "left").withColumn("valid", F.col("p_aware").isNotNull() & F.col("p_blind").isNotNull())
    w, positive = F.col("w"), F.col("positive")
    pa, pb, qa, qb = (F.col(c) for c in ("p_aware", "p_blind", "aware", "blind"))
    sq = lambda x: F.pow(x, F.lit(2))
    parts = {
        "aware_brier": _brier(pa, w, positive),
        "blind_brier": _brier(pb, w, positive),
        "gap": _brier(pa, w, positive) - _brier(pb, w, positive),
        "information": _brier(qa, w, positive) - _brier(qb, w, positive),
        "regret": w * (sq(pa - qa) - sq(pb - qb)),
        "selection": 2 * ((pa - qa) * (w * qa - positive) - (pb - qb) * (w * qb - positive)),
    }
    mass = F.sum(F.when(F.col("valid"), w))
    some = [F.round(F.sum(F.when(F.col("valid"), x)) / mass, 9).alias(k) for k, x in parts.items()]
    return rows.groupBy("specialist").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("valid").cast("bigint")).alias("valid"), F.round(F.coalesce(mass, F.lit(0)) / F.sum("w"), 9).alias("coverage"), *some)


def noisy_lineage(spark: SparkSession, flip_num: int = 1, flip_den: int = 10) -> DataFrame:
    """Where all generalists speak against the specialist, a hint says whether their reports are copied or independent, and is wrong in flip_num of flip_den cases: specialist, generalist, hint, mass, positive (whole numbers over one denominator), noisy (the posterior that allows for the error), trusting (that takes the hint as true) and blind (that ignores it)."""
    rows = packets(worlds(spark)).where("arm <> 'padded' and a = -s and b = -s and c = -s")
    truth = lambda: F.sum(F.when(F.col("y") == 1, F.col("m")).otherwise(F.lit(0).cast("bigint")))
    hints = F.array(F.lit("copied"), F.lit("independent"))
    each = rows.withColumn("hint", F.explode(hints)).withColumn("m", F.col("w") * F.when(F.col("arm") == F.col("hint"), flip_den - flip_num).otherwise(flip_num))
    cells = each.groupBy("specialist", F.col("a").alias("generalist"), "hint").agg(F.sum("m").alias("mass"), truth().alias("positive"))
    own = rows.withColumn("m", F.col("w"))
    trusting = own.groupBy("specialist", F.col("a").alias("generalist"), F.col("arm").alias("hint")).agg(F.round(truth() / F.sum("m"), 9).alias("trusting"))
    blind = packets(worlds(spark)).fillna(0, ["b", "c"]).where("a = -s and b = a and c = a").withColumn("m", F.col("w")).groupBy("specialist", F.col("a").alias("generalist")).agg(F.round(truth() / F.sum("m"), 9).alias("blind"))
    return cells.join(trusting, ["specialist", "generalist", "hint"]).join(blind, ["specialist", "generalist"]).withColumn("noisy", F.round(F.col("positive") / F.col("mass"), 9))


def trace(spark: SparkSession, programs: list[tuple], steps: int = 64) -> DataFrame:
    """programs(name, a, b, rounds): rounds of (a, b) to (a + b, a), then whether the end is above zero. One row for each step: program, step, a, b, result (on the last). Steps are a fold inside the row. A program of more rounds than steps raises."""
    rows = spark.createDataFrame(programs, "program string, a bigint, b bigint, rounds int")
    rows = rows.withColumn("rounds", F.when(F.col("rounds") <= steps, F.col("rounds")).otherwise(F.raise_error(F.concat(F.lit(f"more than {steps} rounds: "), "program")).cast("int")))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest("rounds", F.lit(1))), F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"))), lambda acc, i: F.when(i <= F.col("rounds"), F.concat(acc, F.array(F.struct((F.element_at(acc, -1)["a"] + F.element_at(acc, -1)["b"]).alias("a"), F.element_at(acc, -1)["a"].alias("b"))))).otherwise(acc))
    out = rows.select("program", "rounds", F.posexplode(walk).alias("step", "state"))
    return out.select("program", "step", "state.a", "state.b", F.when(F.col("step") == F.col("rounds"), F.col("state.a") > 0).alias("result"))


def first_cycle(states: DataFrame) -> DataFrame:
    """trace's rows to program, first, again: the earliest step whose state an earlier one had, and that earlier step; null if none comes back."""
    seen = states.withColumn("first", F.min("step").over(Window.partitionBy("program", "a", "b")))
    back = seen.where("step > first").groupBy("program").agg(F.min(F.struct("step", "first")).alias("x"))
    return states.select("program").distinct().join(back, "program", "left").select("program", F.col("x.first").alias("first"), F.col("x.step").alias("again"))


def certificate_check(states: DataFrame, certificates: DataFrame) -> DataFrame:
    """trace's rows and certificates(program, step, a, b, result) to program, valid, problem: the first step at which the certificate differs (state, result), that it lacks (missing), or that the program doesn't have (extra)."""
    own = states.select("program", "step", F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("result").alias("tr"), F.lit(True).alias("real"))
    both = own.join(certificates.select("program", "step", "a", "b", "result", F.lit(True).alias("said")), ["program", "step"], "full")
    problem = F.when(F.col("said").isNull(), "missing").when(F.col("real").isNull(), "extra").when((F.col("a") != F.col("ta")) | (F.col("b") != F.col("tb")), "state").when(~F.col("result").eqNullSafe(F.col("tr")), "result")
    first = both.groupBy("program").agg(F.min(F.when(problem.isNotNull(), F.struct("step", problem.alias("problem")))).alias("x"))
    return first.select("program", F.col("x").isNull().alias("valid"), F.col("x.problem").alias("problem"))


def votes(answers: DataFrame) -> DataFrame:
    """answers(program, voter, answer, weight) to program, majority, weighted, unanimous: null for a tie or no answer."""
    sign = F.when(F.col("answer"), 1).otherwise(-1)
    rows = answers.where("answer is not null").groupBy("program").agg(F.sum(sign).alias("n"), F.sum(sign * F.col("weight")).alias("w"), F.count_distinct("answer").alias("k"), F.first("answer").alias("x"))
    said = lambda c: F.when(F.col(c) != 0, F.col(c) > 0)
    return answers.select("program").distinct().join(rows, "program", "left").select("program", said("n").alias("majority"), said("w").alias("weighted"), F.when(F.col("k") == 1, F.col("x")).alias("unanimous"))


def verifier_scores(verdicts: DataFrame) -> DataFrame:
    """verdicts(verifier, program, valid, accepted) to verifier, n, answered, accuracy (of all; no answer is wrong), false_accepts, false_rejects."""
    n = F.count(F.lit(1))
    right = F.coalesce(F.col("accepted") == F.col("valid"), F.lit(False))
    return verdicts.groupBy("verifier").agg(n.alias("n"), F.count("accepted").alias("answered"), F.round(F.sum(right.cast("int")) / n, 9).alias("accuracy"), F.sum(F.coalesce(F.col("accepted") & ~F.col("valid"), F.lit(False)).cast("bigint")).alias("false_accepts"), F.sum(F.coalesce(~F.col("accepted") & F.col("valid"), F.lit(False)).cast("bigint")).alias("false_rejects"))


def root_order(labels: DataFrame) -> DataFrame:
    """labels(id, place, label) with root: labels as numbers in the order in which they first occur within an id."""
    first = F.min("place").over(Window.partitionBy("id", "label"))
    return labels.withColumn("first_", first).withColumn("root", (F.dense_rank().over(Window.partitionBy("id").orderBy("first_")) - 1).cast("int")).drop("first_")
