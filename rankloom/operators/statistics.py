"""Paired tests, resampling, folds and selections over per-query values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed coefficients of the published approximation.
TAIL = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z):
    """Two-sided tail of the standard normal, by the erfc approximation with relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    p = F.lit(TAIL[-1])
    for a in reversed(TAIL[:-1]):
        p = p * t + a
    return t * F.exp(-x * x + p)


def paired_t(values: DataFrame) -> DataFrame:
    """values(pair, a, b) to pair, n, mean_diff, t, p (normal), wins, losses, ties. No spread counts as a standard error of 1e-12; fewer than two pairs as t 0, p 1."""
    d = F.col("a") - F.col("b")
    rows = values.groupBy("pair").agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"), *[F.sum(x.cast("int")).alias(n) for n, x in (("wins", d > 0), ("losses", d < 0), ("ties", d == 0))])
    t = F.when(F.col("n") < 2, 0.0).otherwise(F.col("mean") / F.when(F.col("var") > 0, F.sqrt(F.col("var") / F.col("n"))).otherwise(1e-12))
    return rows.select("pair", "n", F.round("mean", 9).alias("mean_diff"), F.round(t, 6).alias("t"), F.when(F.col("n") < 2, 1.0).otherwise(F.round(normal_tail(t), 6)).alias("p"), "wins", "losses", "ties")


def splitters(values: DataFrame, key: str, parts: int, each: int = 32) -> list[str]:
    """Keys that split values into about parts ranges of like size: whole keys, evenly spaced in a sorted sample of about each times parts of them, drawn by a hash."""
    n = values.count()
    share = min(1.0, parts * each / max(n, 1))
    lot = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    some = sorted((r[0] for r in values.where(F.col(key).isNotNull() & (lot < share)).select(F.col(key).cast("string")).collect()), key=lambda x: x.encode())
    return sorted({some[i * len(some) // parts] for i in range(1, parts)}, key=lambda x: x.encode()) if some else []


def place(values: DataFrame, key: str = "qid", name: str = "i", parts: int = 256) -> DataFrame:
    """values with the place (from 0) of each row in the order of a unique key, over all rows but without one task that holds them: rows are dealt to ranges between sampled keys, numbered within their range, and moved on by the counts of the ranges before. The sample decides only how evenly the ranges are filled."""
    bounds = splitters(values, key, parts)
    rows = values.withColumn("part_", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key).cast("string"))) if bounds else F.lit(0))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # over at most as many rows as ranges
    starts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(key)) - 1
    return rows.withColumn("own_", own).join(F.broadcast(starts), "part_").withColumn(name, F.col("own_") + F.col("start_")).drop("part_", "own_", "start_")


def draws(spark, n: int, replicates: int, seed: int) -> DataFrame:
    """rep, i: n places out of n for each replicate, from a linear congruence in replicate and position, so any engine draws the same."""
    rows = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), F.expr(f"id % {max(n, 1)}").alias("pos"))
    return rows.select("rep", (F.expr(f"((rep + 1) * 1103515245 + (pos + 1) * (rep + 7) * 12345 + {seed}) % 2147483648") % n).alias("i"))


def resampled(values: DataFrame, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """rep and the means of columns over the queries that the replicate draws, the same for all columns."""
    n = values.count()
    return draws(values.sparkSession, n, replicates, seed).join(place(values), "i").groupBy("rep").agg(*[F.avg(c).alias(c) for c in columns])


def _ordered(means: DataFrame, column: str, indices: tuple[int, int]) -> Column:
    """The means at two places of their ascending order; as many as replicates, a parameter."""
    s = F.sort_array(F.collect_list(column))
    return [F.round(F.element_at(s, F.greatest(F.least(F.lit(i + 1), F.size(s)), F.lit(1))), 9) for i in indices]


def bootstrap(values: DataFrame, replicates: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """values(qid, x) to n, mean, low, high: of the ordered means of resampled queries those at (1 - confidence) / 2 and, one before, (1 + confidence) / 2 of their number (25 and 974 of 1,000). Fewer than two queries have the mean itself."""
    ends = int((1 - confidence) / 2 * replicates), int((1 + confidence) / 2 * replicates) - 1
    means = resampled(values.select("qid", "x"), ["x"], replicates, seed)
    low, high = _ordered(means, "x", ends)
    mean = values.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 9).alias("mean"))
    return mean.join(means.agg(low.alias("low"), high.alias("high")), F.lit(True)).select("n", "mean", F.when(F.col("n") < 2, F.col("mean")).otherwise(F.col("low")).alias("low"), F.when(F.col("n") < 2, F.col("mean")).otherwise(F.col("high")).alias("high"))


def paired_bootstrap(values: DataFrame, replicates: int = 4000, seed: int = 1847) -> DataFrame:
    """values(qid, delta) to n, mean_delta, low, high (places .025 and .975 of the ordered means), wins, losses, ties (within 1e-12)."""
    means = resampled(values.select("qid", "delta"), ["delta"], replicates, seed)
    low, high = _ordered(means, "delta", (int(0.025 * replicates), int(0.975 * replicates)))
    d = F.col("delta")
    signs = {"wins": d > 1e-12, "losses": d < -1e-12, "ties": F.abs(d) <= 1e-12}
    said = values.agg(F.count(d).alias("n"), F.round(F.avg(d), 9).alias("mean_delta"), *[F.sum(x.cast("int")).alias(k) for k, x in signs.items()])
    return said.join(means.agg(low.alias("low"), high.alias("high")), F.lit(True))


#: Fixed bounds of the bands.
MATERIAL, NARROW = 0.10, 0.10


def band(low: Column, high: Column) -> Column:
    """What an envelope says: material beyond MATERIAL on one side, small within it and no wider than NARROW."""
    small = (low >= -MATERIAL) & (high <= MATERIAL) & (high - low <= NARROW)
    return F.when(low > MATERIAL, "material_positive").when(high < -MATERIAL, "material_negative").when(small, "small_under_chosen_bound").otherwise("inconclusive")


def envelope(values: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """values(qid, lower, upper) to n, lower, upper, the .025 and .975 quantiles of both ends under the same draws, the envelope (lowest and highest of them) and its band. Quantiles interpolate."""
    means = resampled(values.select("qid", "lower", "upper"), ["lower", "upper"], replicates, seed)
    ends = [F.round(F.percentile(c, F.lit(p)), 9).alias(f"{c}_{name}") for c in ("lower", "upper") for name, p in (("low", 0.025), ("high", 0.975))]
    rows = values.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lower"), 9).alias("lower"), F.round(F.avg("upper"), 9).alias("upper")).join(means.agg(*ends), F.lit(True))
    return rows.withColumn("interpretation", band(F.col("lower_low"), F.col("upper_high")))


def branch(first: Column, second: Column) -> Column:
    """Whether two years say the same material thing."""
    same = (first == second) & first.isin("material_positive", "material_negative")
    return F.when(same, "advance").otherwise("stop")


def folds(qids: DataFrame, k: int = 5, how: str = "striped", seed: int = 42) -> DataFrame:
    """qid, fold. striped: over the sorted ids; chunks: runs of equal length of the ids in an order that the seed gives, the rest in the last; shuffled: striped over that order."""
    rows = qids.select("qid").distinct()
    if how != "striped":
        rows = rows.withColumn("mixed", F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), "qid")), "qid"))
    rows = place(rows, "qid" if how == "striped" else "mixed")
    if how == "chunks":
        return rows.select("qid", F.least(F.expr(f"i div {max(rows.count() // k, 1)}"), F.lit(k - 1)).cast("int").alias("fold"))
    return rows.select("qid", (F.col("i") % k).cast("int").alias("fold"))


def select_in_folds(values: DataFrame, of: DataFrame, candidate: str) -> DataFrame:
    """values(qid, candidate, x), of(qid, fold) to fold, the candidate with the best mean outside the fold (the smaller of equals) and its mean inside."""
    rows = values.join(of, "qid")
    sums = rows.groupBy("fold", candidate).agg(F.sum("x").alias("sx"), F.count("x").alias("n"))
    every = Window.partitionBy(candidate)
    train = sums.select("fold", candidate, F.round((F.sum("sx").over(every) - F.col("sx")) / (F.sum("n").over(every) - F.col("n")), 9).alias("train"), F.round(F.col("sx") / F.col("n"), 9).alias("held_out"))
    return train.withColumn("i", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("train"), candidate))).where("i = 1").select("fold", F.col(candidate).alias("chosen"), "train", "held_out")


def spearman(values: DataFrame) -> DataFrame:
    """values(pair, qid, a, b) to pair, n, rho of ranks in which ties share the first place."""
    own = lambda c: F.rank().over(Window.partitionBy("pair").orderBy(c))
    rows = values.withColumn("d", own("a") - own("b"))
    n = F.count(F.lit(1))
    return rows.groupBy("pair").agg(n.alias("n"), F.round(F.when(n < 2, 0.0).otherwise(1 - 6 * F.sum(F.col("d") * F.col("d")) / F.nullif(n * (n * n - 1), F.lit(0))), 9).alias("rho"))


def strata(regimes: DataFrame, easy: float = 0.4, hard: float = 0.7) -> DataFrame:
    """qid, stratum by the disagreement tq."""
    return regimes.select("qid", F.when(F.col("tq") < easy, "easy").when(F.col("tq") < hard, "medium").otherwise("hard").alias("stratum"))


def zscores(values: DataFrame, column: str, floor: float = 1e-3) -> DataFrame:
    """values(qid, source, column) with z: across the query's sources, the deviation at least floor; 0 for one source."""
    own = Window.partitionBy("qid")
    z = (F.col(column) - F.avg(column).over(own)) / F.greatest(F.stddev_pop(column).over(own), F.lit(floor))
    return values.withColumn("z", F.round(F.when(F.count(F.lit(1)).over(own) < 2, 0.0).otherwise(z), 9) + 0.0)


def joint_errors(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs(truth, g_error, s_error, ...by) to tables of joint errors, over all rows (group all), by truth, and by each column of by: group, value, n, n00..n11, g_error, s_error, disagreement, correction and harm (shares of all), conditional ones, s_minus_g, and excess_num / excess_den of joint errors over independent ones. One pass over grouping sets."""
    sets = ["truth", *(by or [])]
    labels = F.array(F.struct(F.lit("all").alias("group"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("group"), F.col(c).cast("string").alias("value")) for c in sets])
    rows = pairs.select(F.inline(labels), F.col("g_error").cast("int").alias("g"), F.col("s_error").cast("int").alias("s"))
    cell = lambda g, s: F.sum(((F.col("g") == g) & (F.col("s") == s)).cast("bigint"))
    rows = rows.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"), *[cell(g, s).alias(f"n{g}{s}") for g in (0, 1) for s in (0, 1)])
    g, s, n = F.col("n10") + F.col("n11"), F.col("n01") + F.col("n11"), F.col("n")
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 9)
    return rows.select("group", "value", "n", "n00", "n01", "n10", "n11", share(g, n).alias("g_error"), share(s, n).alias("s_error"), share(F.col("n10") + F.col("n01"), n).alias("disagreement"), share(F.col("n10"), n).alias("correction"), share(F.col("n10"), g).alias("conditional_correction"), share(F.col("n01"), n).alias("harm"), share(F.col("n01"), n - g).alias("conditional_harm"), share(s - g, n).alias("s_minus_g"), (F.col("n11") * n - g * s).alias("excess_num"), (n * n).alias("excess_den"))


def extremes(values: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n lowest and the n highest rows of values(qid, column): side, place, qid, column. Only they reach one task."""
    one = lambda side, order: values.select("qid", column).orderBy(order, "qid").limit(n).select(F.lit(side).alias("side"), "qid", column).withColumn("place", F.row_number().over(Window.orderBy(order, "qid")))
    return one("worst", F.asc(column)).unionByName(one("best", F.desc(column)))


def paired_summary(values: DataFrame) -> DataFrame:
    """values(pair, delta) to pair, n, mean, least, most and signs."""
    d = F.col("delta")
    return values.groupBy("pair").agg(F.count(d).alias("n"), F.round(F.avg(d), 9).alias("mean"), F.round(F.min(d), 9).alias("least"), F.round(F.max(d), 9).alias("most"), *[F.sum(x.cast("int")).alias(k) for k, x in (("positive", d > 0), ("negative", d < 0), ("zero", d == 0))])
