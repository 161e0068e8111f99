"""Exact bounds on metric differences when judgments are missing. Everything is a scaled integer: coefficients first cancel within a document, and only then does an unknown document widen the interval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: lcm of 1..3 for grades, 5^10 for ten ranks at persistence 4/5.
RBP_SCALE = 3 * 5**10


def status(lower: Column, upper: Column) -> Column:
    return F.when(lower > 0, "b_better").when(upper < 0, "a_better").when((lower == 0) & (upper == 0), "tie").otherwise("unresolved")


def decision(lower: Column, upper: Column) -> tuple[Column, Column]:
    """Sign and decision of an interval."""
    sign = F.when(lower > 0, "strict_positive").when(upper < 0, "strict_negative").when((lower == 0) & (upper == 0), "point_zero").when(upper == 0, "nonpositive_with_zero").when(lower == 0, "nonnegative_with_zero").otherwise("crosses_zero")
    return sign, F.when(lower > 0, "all_completions_positive").when(upper <= 0, "positive_excluded").otherwise("sign_unresolved")


def interval(coefficients: DataFrame, qrels: DataFrame, by: list[str], known_gain: Column, best_gain: int = 1) -> DataFrame:
    """coefficients(by, qid, docid, coef) to by, known, lower, upper, unknown: integer sums. best_gain: what an unknown document gains at most, in known_gain's unit."""
    rows = coefficients.join(qrels, ["qid", "docid"], "left")
    unknown = F.col("grade").isNull()
    known = F.sum(F.when(unknown, F.lit(0).cast("bigint")).otherwise(F.col("coef") * known_gain))
    low = F.sum(F.when(unknown, F.least("coef", F.lit(0).cast("bigint")) * best_gain).otherwise(F.lit(0).cast("bigint")))
    high = F.sum(F.when(unknown, F.greatest("coef", F.lit(0).cast("bigint")) * best_gain).otherwise(F.lit(0).cast("bigint")))
    return rows.groupBy(*by).agg(known.alias("known"), (known + low).alias("lower"), (known + high).alias("upper"), F.sum(unknown.cast("int")).alias("unknown"))


def rbp_coefficients(a: DataFrame, b: DataFrame, depth: int = 10) -> DataFrame:
    """Two rankings(qid, docid, rank0) to qid, docid, coef (of B less A, over 5^depth), rank_a, rank_b."""
    weight = F.element_at(F.array(*[F.lit(4**i * 5 ** (depth - 1 - i)).cast("bigint") for i in range(depth)]), F.col("rank0") + 1)
    side = lambda df, sign, name: df.where(F.col("rank0") < depth).select("qid", "docid", (weight * sign).alias("coef"), F.lit(name).alias("side"), "rank0")
    rows = side(a, -1, "a").unionByName(side(b, 1, "b"))
    one = lambda name: F.max(F.when(F.col("side") == name, F.col("rank0") + 1))
    return rows.groupBy("qid", "docid").agg(F.sum("coef").alias("coef"), one("a").alias("rank_a"), one("b").alias("rank_b"))


def rbp_bounds(a: DataFrame, b: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, known, lower, upper (numerators over RBP_SCALE), unknown, status of RBP@10 of B less A."""
    rows = interval(rbp_coefficients(a, b), qrels, ["qid"], F.col("grade"), 3)
    return rows.withColumn("status", status(F.col("lower"), F.col("upper")))


def acquisition_plan(a: DataFrame, b: DataFrame, qrels: DataFrame, budgets=(0, 1, 3)) -> DataFrame:
    """qid, budget, pool (unknown documents), realized, width (all unknown), by_influence, by_head and by_chance (widths left after judging so many unknown documents: those of most influence, those highest up, or expected of any, as numerator over pool), shared (documents that the first two choose both)."""
    rows = rbp_coefficients(a, b).join(qrels.select("qid", "docid"), ["qid", "docid"], "left_anti").withColumn("size", F.abs("coef"))
    own = Window.partitionBy("qid")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy(F.desc("size"), "docid"))).withColumn("h", F.row_number().over(own.orderBy(F.least(F.coalesce("rank_a", F.lit(11)), F.coalesce("rank_b", F.lit(11))), "docid")))
    each = rows.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    left = lambda c: F.sum(F.when(F.col(c) > F.col("budget"), F.col("size")).otherwise(F.lit(0).cast("bigint")))
    n = F.count(F.lit(1))
    realized = F.least(F.max("budget"), n)
    shared = F.sum(((F.col("i") <= F.col("budget")) & (F.col("h") <= F.col("budget"))).cast("bigint"))
    return each.groupBy("qid", "budget").agg(n.alias("pool"), realized.alias("realized"), F.sum("size").alias("width"), left("i").alias("by_influence"), left("h").alias("by_head"), (F.sum("size") * (n - realized)).alias("by_chance"), shared.alias("shared"))


def acquisition_summary(plans: DataFrame, queries: DataFrame) -> DataFrame:
    """Plans of all queries(qid) to budget, queries, nonempty, realized, the mean width before and after each way to choose (over RBP_SCALE / 3), how many queries choose alike both ways, and how many documents both choose. Queries without unknown documents count as width zero."""
    n = queries.select("qid").distinct().agg(F.count(F.lit(1)).alias("queries"))
    mean = lambda c: F.round(F.sum(c) / F.max("queries"), 6)
    rows = plans.join(F.broadcast(n), F.lit(True)).groupBy("budget")
    alike = F.sum((F.col("shared") == F.col("realized")).cast("bigint")) + F.max("queries") - F.count(F.lit(1))
    return rows.agg(F.max("queries").alias("queries"), F.count(F.lit(1)).alias("nonempty"), F.sum("realized").alias("realized"), mean("width").alias("width"), mean("by_influence").alias("by_influence"), mean("by_head").alias("by_head"), mean(F.col("by_chance") / F.col("pool")).alias("by_chance"), alike.alias("alike"), F.sum("shared").alias("shared"))


def annual_summary(intervals: DataFrame) -> DataFrame:
    """intervals(group, qid, lower, upper, unknown) to group, queries, mean_lower, mean_upper, mean_width (numerators over the queries), status of the mean, and how many queries have each status, no width, or unknown documents."""
    st = status(F.col("lower"), F.col("upper"))
    count = lambda c: F.sum(c.cast("bigint"))
    low, high = F.sum("lower"), F.sum("upper")
    rows = intervals.withColumn("st", st).groupBy("group").agg(F.count(F.lit(1)).alias("queries"), low.alias("lower"), high.alias("upper"), (high - low).alias("width"), *[count(F.col("st") == x).alias(x) for x in ("a_better", "b_better", "tie", "unresolved")], count(F.col("lower") == F.col("upper")).alias("zero_width"), count(F.col("unknown") > 0).alias("with_unknown"))
    return rows.withColumn("status", status(F.col("lower"), F.col("upper")))


def head_coefficients(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two heads(qid, docid) to qid, docid, coef of the documents that only one has (over 10)."""
    rows = left.select("qid", "docid", F.lit(1).cast("bigint").alias("coef")).unionByName(right.select("qid", "docid", F.lit(-1).cast("bigint").alias("coef")))
    return rows.groupBy("qid", "docid").agg(F.sum("coef").alias("coef")).where("coef <> 0")


def p10_bounds(left: DataFrame, right: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, known, lower, upper (over 10), unknown, sign, decision of P@10 of left less right; queries with equal heads have none."""
    rows = interval(head_coefficients(left, right), qrels, ["qid"], (F.col("grade") > 0).cast("bigint"))
    sign, said = decision(F.col("lower"), F.col("upper"))
    return rows.withColumn("sign", sign).withColumn("decision", said)


def minority_exchange(majority: DataFrame, specialist: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Rankings(qid, docid, rank0) to qid, admitted, displaced: where no document of the specialist alone is in the hybrid's head, but one is in the specialist's, its first such document takes the tenth place."""
    only = specialist.join(majority.select("qid", "docid"), ["qid", "docid"], "left_anti")
    head = hybrid.where("rank0 < 10")
    has = head.join(only.select("qid", "docid"), ["qid", "docid"], "left_semi").select("qid").distinct()
    first = only.where("rank0 < 10").groupBy("qid").agg(F.min_by("docid", "rank0").alias("admitted")).join(has, "qid", "left_anti")
    return first.join(head.where("rank0 = 9").select("qid", F.col("docid").alias("displaced")), "qid")


def generic_exchange(majority: DataFrame, specialist: DataFrame, hybrid: DataFrame) -> DataFrame:
    """As minority_exchange, for the same queries, but the specialist's first document outside the hybrid's head is admitted, whoever else holds it: qid, policy (M or J), admitted, displaced."""
    m = minority_exchange(majority, specialist, hybrid)
    outside = specialist.where("rank0 < 10").join(hybrid.where("rank0 < 10").select("qid", "docid"), ["qid", "docid"], "left_anti")
    j = m.select("qid", "displaced").join(outside.groupBy("qid").agg(F.min_by("docid", "rank0").alias("admitted")), "qid")
    return m.select("qid", F.lit("M").alias("policy"), "admitted", "displaced").unionByName(j.select("qid", F.lit("J").alias("policy"), "admitted", "displaced"))


def exchange_ledger(exchanges: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, admitted, displaced, category: rescue, harm, neutral or unresolved."""
    g = lambda name: qrels.select("qid", F.col("docid").alias(name), F.col("grade").alias(f"g_{name}"))
    rows = exchanges.join(g("admitted"), ["qid", "admitted"], "left").join(g("displaced"), ["qid", "displaced"], "left")
    a, d = F.col("g_admitted"), F.col("g_displaced")
    category = F.when(a.isNull() | d.isNull(), "unresolved").when((a > 0) & (d == 0), "rescue").when((a == 0) & (d > 0), "harm").otherwise("neutral")
    return rows.select("qid", "admitted", "displaced", category.alias("category"))


def team_bounds(heads: DataFrame, fused: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """heads(team, source, qid, docid) of members and fused(team, qid, docid) of teams to by, known, lower, upper, unknown and scale: P@10 of the team's fused head less the members' mean, summed over everything but by. Coefficients are pooled over teams before an unknown document widens the interval, so what cancels between teams doesn't count. Each team's members weigh alike."""
    n = heads.select("team", "source").distinct().groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    sizes = [r["n"] for r in n.select("n").distinct().collect()]  # at most as many as a team has members
    scale = F.lit(math.lcm(*sizes)).cast("bigint")  # a common multiple of the team sizes; too great a one raises
    unit = n.withColumn("scale", scale)
    plus = fused.join(unit, "team").select("team", "qid", "docid", F.col("scale").alias("coef"))
    minus = heads.join(unit, "team").select("team", "qid", "docid", (-(F.col("scale") / F.col("n"))).cast("bigint").alias("coef"))
    keys = list(dict.fromkeys([*by, "qid", "docid"]))
    pooled = plus.unionByName(minus).groupBy(*keys).agg(F.sum("coef").alias("coef")).where("coef <> 0")
    return interval(pooled, qrels, by, (F.col("grade") > 0).cast("bigint")) if by else interval(pooled.withColumn("all", F.lit(0)), qrels, ["all"], (F.col("grade") > 0).cast("bigint")).drop("all")


def exclusion_certificate(runs: DataFrame, lexical: list[str], specialist: str, k: int = 60) -> DataFrame:
    """qid, t (tenth score of the lexical lists), v (best score of a document that only the specialist has), certified: whether no such document can reach the head. Scores are over 10^15, rounded down for t and up for v, so a certificate is never wrong."""
    unit = 10**15
    sums = runs.where(F.col("source").isin(lexical)).groupBy("qid", "docid").agg(F.sum(F.floor(F.lit(unit).cast("decimal(16,0)") / (k + F.col("rank") + 1).cast("decimal(6,0)")).cast("bigint")).alias("x"))
    placed = sums.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("x"), "docid")))
    tenth = placed.where("i = 10").select("qid", F.col("x").alias("t"))
    alone = runs.where(F.col("source") == specialist).join(sums.select("qid", "docid"), ["qid", "docid"], "left_anti")
    best = alone.groupBy("qid").agg(F.min("rank").alias("rank")).select("qid", (F.floor(F.lit(unit).cast("decimal(16,0)") / (k + F.col("rank") + 1).cast("decimal(6,0)")).cast("bigint") + 1).alias("v"))
    return runs.select("qid").distinct().join(tenth, "qid", "left").join(best, "qid", "left").withColumn("certified", F.coalesce(F.col("t") > F.col("v"), F.lit(False)))


def scalar_interval(head: DataFrame, a: DataFrame, s: DataFrame) -> DataFrame:
    """For which weights w >= 0 does w * a + s put exactly head(qid, docid) on top? a and s(qid, docid, x) are integer scores, absent is 0. qid, lower_num, lower_den, lower_strict, upper_num, upper_den, upper_strict (null: none), feasible, reason (feasible, empty_interval, zero_slope, or coverage: a document of the head in neither list), and the pair of documents that sets each end. A query gives 10 times its other candidates' inequalities; they are compared by cross-multiplication and never rounded."""
    both = a.select("qid", "docid", F.col("x").alias("a"), F.lit(0).cast("bigint").alias("s")).unionByName(s.select("qid", "docid", F.lit(0).cast("bigint").alias("a"), F.col("x").alias("s"))).groupBy("qid", "docid").agg(F.sum("a").alias("a"), F.sum("s").alias("s"))
    outside = both.join(head.select("qid", "docid"), ["qid", "docid"], "left_anti").select("qid", F.struct("docid", "a", "s").alias("y"))
    inside = head.select("qid", "docid").join(both, ["qid", "docid"]).groupBy("qid").agg(F.collect_list(F.struct("docid", "a", "s")).alias("xs"))
    rows = outside.join(inside, "qid").select("qid", "y", F.explode("xs").alias("x"))
    rows = rows.select("qid", (F.col("x.a") - F.col("y.a")).cast("decimal(18,0)").alias("den"), (F.col("y.s") - F.col("x.s")).cast("decimal(18,0)").alias("num"), (F.col("y.docid") < F.col("x.docid")).alias("strict"), F.col("x.docid").alias("head"), F.col("y.docid").alias("excluded"))
    stuck = F.max((F.col("den") == 0) & ((F.col("num") > 0) | ((F.col("num") == 0) & F.col("strict"))))
    # a fraction sorts exactly as whole part, then 18 digits of the rest, as denominators are below 10^9 two unlike fractions differ by more
    whole = F.floor(F.col("num") / F.col("den")).cast("decimal(18,0)")
    rest = (F.col("num") - whole * F.col("den")).cast("decimal(18,0)")
    sized = lambda strict: F.struct(whole.alias("w"), ((rest * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") / F.col("den")).alias("r"), strict.alias("strict"), F.col("num").cast("bigint").alias("num"), F.col("den").cast("bigint").alias("den"), "head", "excluded")
    tight = F.col("strict").cast("int")
    found = rows.groupBy("qid").agg(F.max(F.when((F.col("den") > 0) & (F.col("num") >= 0), sized(tight))).alias("lo"), F.min(F.when(F.col("den") < 0, sized(1 - tight))).alias("hi"), stuck.alias("stuck"))
    low_num, low_den, low_strict = F.coalesce("lo.num", F.lit(0).cast("bigint")), F.coalesce("lo.den", F.lit(1).cast("bigint")), F.coalesce(F.col("lo.strict") == 1, F.lit(False))
    hi_strict = F.col("hi.strict") == 0
    left, right = low_num.cast("decimal(18,0)") * (-F.col("hi.den")).cast("decimal(18,0)"), (-F.col("hi.num")).cast("decimal(18,0)") * low_den.cast("decimal(18,0)")
    open_ = F.col("hi").isNull() | (left < right) | ((left == right) & ~low_strict & ~hi_strict)
    uncovered = head.select("qid", "docid").join(both.select("qid", "docid"), ["qid", "docid"], "left_anti").groupBy("qid").agg(F.count(F.lit(1)).alias("uncovered"))
    out = found.join(uncovered, "qid", "left")
    reason = F.when(F.col("uncovered").isNotNull(), "coverage").when(F.coalesce("stuck", F.lit(False)), "zero_slope").when(open_, "feasible").otherwise("empty_interval")
    return out.select("qid", low_num.alias("lower_num"), low_den.alias("lower_den"), low_strict.alias("lower_strict"), (-F.col("hi.num")).alias("upper_num"), (-F.col("hi.den")).alias("upper_den"), F.when(F.col("hi").isNotNull(), hi_strict).alias("upper_strict"), (reason == "feasible").alias("feasible"), reason.alias("reason"), F.col("lo.head").alias("lower_head"), F.col("lo.excluded").alias("lower_excluded"), F.col("hi.head").alias("upper_head"), F.col("hi.excluded").alias("upper_excluded"))


def share_bounds(groups: DataFrame, qrels: DataFrame, relevant: int = 2) -> DataFrame:
    """groups(qid, docid, group) to group, n, relevant, unknown, lower and upper share that is relevant, whatever the unknown are."""
    rows = groups.join(qrels, ["qid", "docid"], "left")
    n, r, u = F.count(F.lit(1)), F.sum((F.coalesce("grade", F.lit(-1)) >= relevant).cast("int")), F.sum(F.col("grade").isNull().cast("int"))
    return rows.groupBy("group").agg(n.alias("n"), r.alias("relevant"), u.alias("unknown"), F.round(r / n, 9).alias("lower"), F.round((r + u) / n, 9).alias("upper"))


def observability(runs: DataFrame, qrels: DataFrame, heads=(10, 30)) -> DataFrame:
    """source, and for each head how many documents are judged, and of how many no other list of the query has any."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("qid", "docid")) == 1
    rows = runs.withColumn("alone", alone).join(qrels, ["qid", "docid"], "left")
    cols = []
    for k in heads:
        inside = F.col("rank") < k
        cols += [F.sum((inside & F.col("grade").isNotNull()).cast("int")).alias(f"judged{k}"), F.sum((inside & F.col("alone")).cast("int")).alias(f"alone{k}"), F.sum((inside & F.col("alone") & F.col("grade").isNotNull()).cast("int")).alias(f"judged_alone{k}")]
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *cols)


def average(intervals: DataFrame, triggered: DataFrame | None = None) -> DataFrame:
    """intervals(qid, known, lower, upper, unknown) to scope (all, or triggered: only queries of triggered(qid)), queries and sums over them, with sign and decision of the mean. No query has no row."""
    rows = intervals.withColumn("scope", F.lit("all"))
    if triggered is not None:
        rows = rows.unionByName(intervals.join(triggered.select("qid").distinct(), "qid", "left_semi").withColumn("scope", F.lit("triggered")))
    rows = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in ("known", "lower", "upper", "unknown")])
    sign, said = decision(F.col("lower"), F.col("upper"))
    return rows.withColumn("sign", sign).withColumn("decision", said)


def label_changes(early: DataFrame, late: DataFrame) -> DataFrame:
    """Two qrels to qid, docid, early_grade, late_grade, kind: added, removed or revised; equal ones have no row."""
    both = early.select("qid", "docid", F.col("grade").alias("early_grade")).join(late.select("qid", "docid", F.col("grade").alias("late_grade")), ["qid", "docid"], "full")
    kind = F.when(F.col("early_grade").isNull(), "added").when(F.col("late_grade").isNull(), "removed").otherwise("revised")
    return both.where(~F.col("early_grade").eqNullSafe(F.col("late_grade"))).withColumn("kind", kind)


def compare_phases(coefficients: DataFrame, early: DataFrame, late: DataFrame) -> DataFrame:
    """coefficients(qid, docid, coef) under two states of the judgments, relevance binary: qid, both intervals, width_reduction, revealed (documents that became known), raised and lowered (by how much the lower end rose and the upper fell), nested (whether the later interval lies within the earlier one, as it must if grades are only added), both decisions."""
    gain = (F.col("grade") > 0).cast("bigint")
    one = lambda q, name: interval(coefficients, q, ["qid"], gain).select("qid", *[F.col(c).alias(f"{name}_{c}") for c in ("lower", "upper", "unknown")])
    rows = one(early, "early").join(one(late, "late"), "qid")
    raised, lowered = F.col("late_lower") - F.col("early_lower"), F.col("early_upper") - F.col("late_upper")
    said = lambda name: decision(F.col(f"{name}_lower"), F.col(f"{name}_upper"))[1].alias(f"{name}_decision")
    return rows.select("qid", "early_lower", "early_upper", "late_lower", "late_upper", (raised + lowered).alias("width_reduction"), (F.col("early_unknown") - F.col("late_unknown")).alias("revealed"), raised.alias("raised"), lowered.alias("lowered"), ((raised >= 0) & (lowered >= 0)).alias("nested"), said("early"), said("late"))


def control_coefficients(heads: DataFrame, controls: DataFrame, count: int) -> DataFrame:
    """heads(name, qid, docid) of named policies and controls(rep, qid, docid), the heads of count replicates, to contrast, qid, docid, coef: each policy less the controls' mean (name-C), over count times ten."""
    mean = controls.groupBy("qid", "docid").agg((-F.count(F.lit(1))).alias("coef"))
    names = heads.select("name").distinct()
    minus = mean.join(F.broadcast(names), F.lit(True)).select(F.concat("name", F.lit("-C")).alias("contrast"), "qid", "docid", "coef")  # policies are a parameter, a few names
    plus = heads.select(F.concat("name", F.lit("-C")).alias("contrast"), "qid", "docid", F.lit(count).cast("bigint").alias("coef"))
    return plus.unionByName(minus).groupBy("contrast", "qid", "docid").agg(F.sum("coef").alias("coef")).where("coef <> 0")


def share_contrast(groups: DataFrame, qrels: DataFrame, first: str = "tail_supported", second: str = "isolated", relevant: int = 2) -> DataFrame:
    """groups(qid, docid, group) to qid, lower, upper, width of the first group's relevant share less the second's, whatever the unknown are; queries that lack one of them have no row."""
    rows = groups.join(qrels, ["qid", "docid"], "left").groupBy("qid", "group").agg(F.count(F.lit(1)).alias("n"), F.sum((F.coalesce("grade", F.lit(-1)) >= relevant).cast("int")).alias("r"), F.sum(F.col("grade").isNull().cast("int")).alias("u"))
    one = lambda name, p: rows.where(F.col("group") == name).select("qid", (F.col("r") / F.col("n")).alias(f"{p}l"), ((F.col("r") + F.col("u")) / F.col("n")).alias(f"{p}u"))
    both = one(first, "a").join(one(second, "b"), "qid")
    low, high = F.col("al") - F.col("bu"), F.col("au") - F.col("bl")
    return both.select("qid", F.round(low, 9).alias("lower"), F.round(high, 9).alias("upper"), F.round(high - low, 9).alias("width"))


def association(groups: DataFrame, qrels: DataFrame, of: DataFrame, names: list[str], first: str = "tail_supported", second: str = "isolated", relevant: int = 2, replicates: int = 10_000) -> DataFrame:
    """groups(qid, docid, group), of(qid, collection) to one row for each collection of names: queries, eligible (those with both groups), excluded (the ids of the others, sorted, joined by blanks; as many as a collection has queries), the mean ends of the contrast over eligible queries, the envelope of resampled ends, what it says, and branch: whether all collections say the same material thing. A collection without eligible queries has no envelope."""
    from rankloom.operators import statistics

    have = groups.groupBy("qid").agg(F.collect_set("group").alias("groups"))
    every = of.join(have, "qid", "left").withColumn("eligible", F.coalesce(F.array_contains("groups", first) & F.array_contains("groups", second), F.lit(False)))
    counts = every.groupBy("collection").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.col("eligible").cast("bigint")).alias("eligible"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("eligible"), F.col("qid")))), " ").alias("excluded"))
    ends = share_contrast(groups, qrels, first, second, relevant).join(of, "qid")
    found = None
    for name in names:
        one = statistics.envelope(ends.where(F.col("collection") == name).select("qid", "lower", "upper"), replicates).select(F.lit(name).alias("collection"), "lower", "upper", F.col("lower_low").alias("low"), F.col("upper_high").alias("high"), "interpretation")
        found = one if found is None else found.unionByName(one)
    out = counts.join(found, "collection")
    whole = Window.partitionBy()  # a row for each collection
    same = (F.min("interpretation").over(whole) == F.max("interpretation").over(whole)) & F.col("interpretation").isin("material_positive", "material_negative")
    return out.withColumn("branch", F.when(same, "advance").otherwise("stop"))


def _fraction(num: Column, den: Column) -> Column:
    """A fraction with a positive denominator below 10^9 as a struct that sorts exactly: its whole part, then 18 digits of the rest."""
    n, d = num.cast("decimal(18,0)"), den.cast("decimal(18,0)")
    whole = F.floor(n / d).cast("decimal(18,0)")
    rest = (n - whole * d).cast("decimal(18,0)")
    return F.struct(whole.alias("w"), ((rest * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)") / d).alias("r"))


def common_interval(intervals: DataFrame) -> DataFrame:
    """scalar_interval's rows to one: the weights that serve all queries. queries, infeasible (how many have none), feasible, reason (feasible, query_infeasible or empty_common), and both ends with the first query that sets each (null: none does)."""
    low = F.struct(_fraction(F.col("lower_num"), F.col("lower_den")).alias("x"), F.col("lower_strict").cast("int").alias("strict"))
    high = F.when(F.col("upper_den").isNotNull(), F.struct(_fraction(F.col("upper_num"), F.col("upper_den")).alias("x"), (1 - F.col("upper_strict").cast("int")).alias("loose")))
    rows = intervals.withColumn("low", low).withColumn("high", high)
    ends = rows.agg(F.count(F.lit(1)).alias("queries"), F.sum((~F.col("feasible")).cast("bigint")).alias("infeasible"), F.max("low").alias("lo"), F.min("high").alias("hi"))
    both = rows.join(F.broadcast(ends), F.lit(True))  # one row
    own = lambda side, end: F.min(F.when(F.col(side) == F.col(end), F.struct("qid", *[c for c in intervals.columns if c.startswith({"low": "lower", "high": "upper"}[side])])))
    rows = both.agg(F.max("queries").alias("queries"), F.max("infeasible").alias("infeasible"), own("low", "lo").alias("l"), own("high", "hi").alias("h"))
    left = F.col("l.lower_num").cast("decimal(18,0)") * F.col("h.upper_den").cast("decimal(18,0)")
    right = F.col("h.upper_num").cast("decimal(18,0)") * F.col("l.lower_den").cast("decimal(18,0)")
    some = F.col("h").isNull() | (left < right) | ((left == right) & ~F.col("l.lower_strict") & ~F.col("h.upper_strict"))
    reason = F.when(F.col("infeasible") > 0, "query_infeasible").when(some, "feasible").otherwise("empty_common")
    ratio = lambda a, b: F.round(F.col(a) / F.col(b), 9)
    return rows.select("queries", "infeasible", (reason == "feasible").alias("feasible"), reason.alias("reason"), ratio("l.lower_num", "l.lower_den").alias("lower"), F.col("l.lower_strict"), F.col("l.qid").alias("lower_qid"), ratio("h.upper_num", "h.upper_den").alias("upper"), F.col("h.upper_strict"), F.col("h.qid").alias("upper_qid")).where("queries > 0")
