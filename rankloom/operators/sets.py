"""Overlaps, coverage and who owns what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairwise_jaccard(runs: DataFrame, top: int = 30) -> DataFrame:
    """qid, a, b (sources, a before b), jaccard of their heads. Heads are bounded, so a query has at most top times as many pairs as there are pairs of lists."""
    head = runs.where(F.col("rank") < top).select("qid", "source", "docid")
    size = head.groupBy("qid", "source").agg(F.count(F.lit(1)).alias("n"))
    pairs = size.select("qid", F.col("source").alias("a"), F.col("n").alias("na")).join(size.select("qid", F.col("source").alias("b"), F.col("n").alias("nb")), "qid").where("a < b")
    by_doc = head.groupBy("qid", "docid").agg(F.sort_array(F.collect_set("source")).alias("s"))
    shared = by_doc.select("qid", "s", F.posexplode("s").alias("i", "a")).select("qid", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("qid", "a", "b").agg(F.count(F.lit(1)).alias("o"))
    o = F.coalesce("o", F.lit(0))
    return pairs.join(shared, ["qid", "a", "b"], "left").select("qid", "a", "b", F.round(o / (F.col("na") + F.col("nb") - o + 1e-12), 9).alias("jaccard"))


def specialists(runs: DataFrame, head: int = 10, others: int = 30) -> DataFrame:
    """qid, docid, owner, owner_rank (from 1), stratum, group: documents in one list's head that no other list has among its first others; tail_supported if another has them further down. One aggregation, no join of lists."""
    rows = runs.groupBy("qid", "docid").agg(F.min(F.struct("rank", "source")).alias("best"), F.count(F.lit(1)).alias("n"), F.sum((F.col("rank") < others).cast("int")).alias("near"))
    r = F.col("best.rank") + 1
    return rows.where((r <= head) & (F.col("near") == 1)).select("qid", "docid", F.col("best.source").alias("owner"), r.alias("owner_rank"), F.when(r <= 3, "rank1_3").otherwise("rank4_10").alias("stratum"), F.when(F.col("n") > 1, "tail_supported").otherwise("isolated").alias("group"))


def group_outcomes(owned: DataFrame, qrels: DataFrame) -> DataFrame:
    """stratum, group, n, judged, judged_share, relevant_share (among judged; null if none), mean_gain."""
    rows = owned.join(qrels, ["qid", "docid"], "left")
    judged = F.count("grade")
    return rows.groupBy("stratum", "group").agg(F.count(F.lit(1)).alias("n"), judged.alias("judged"), F.round(judged / F.count(F.lit(1)), 9).alias("judged_share"), F.round(F.sum((F.col("grade") >= 2).cast("int")) / F.nullif(judged, F.lit(0)), 9).alias("relevant_share"), F.round(F.avg(F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1), 9).alias("mean_gain"))


def support_partition(runs: DataFrame, qrels: DataFrame, lexical: list[str], specialist: str) -> DataFrame:
    """qid, partition, n: relevant documents by whether the lexical lists, the specialist list, both or neither hold them."""
    have = runs.groupBy("qid", "docid").agg(F.max(F.col("source").isin(lexical).cast("int")).alias("u"), F.max((F.col("source") == specialist).cast("int")).alias("s"))
    rows = qrels.where("grade > 0").join(have, ["qid", "docid"], "left")
    u, s = F.coalesce("u", F.lit(0)) == 1, F.coalesce("s", F.lit(0)) == 1
    return rows.groupBy("qid", F.when(u & s, "U-and-S").when(u, "U-only").when(s, "S-only").otherwise("neither").alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def diversity(runs: DataFrame, qrels: DataFrame, top: int = 30) -> DataFrame:
    """source, mean_relevant10, mean_unique: relevant documents in the head, and those of the first top that no other list has there, by list."""
    rows = runs.where(F.col("rank") < top).withColumn("alone", (F.count(F.lit(1)).over(Window.partitionBy("qid", "docid")) == 1).cast("int")).join(qrels, ["qid", "docid"], "left")
    each = rows.groupBy("qid", "source").agg(F.sum(((F.col("grade") >= 2) & (F.col("rank") < 10)).cast("int")).alias("rel"), F.sum("alone").alias("alone"))
    return each.groupBy("source").agg(F.round(F.avg(F.coalesce("rel", F.lit(0))), 9).alias("mean_relevant10"), F.round(F.avg("alone"), 9).alias("mean_unique"))


def tie_statistics(runs: DataFrame) -> DataFrame:
    """qid, source, tie_groups, tied_docs, tie_excess."""
    groups = runs.groupBy("qid", "source", "score").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("qid", "source").agg(F.sum((F.col("n") > 1).cast("int")).alias("tie_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("tied_docs"), F.sum(F.col("n") - 1).alias("tie_excess"))


def mean_jaccard(runs: DataFrame, top: int = 30) -> DataFrame:
    """a, b (sources), queries, jaccard: the mean over queries with both of their heads' overlap; heads are never empty, so no union is."""
    exact = pairwise_jaccard(runs, top)
    return exact.groupBy("a", "b").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("jaccard"), 8).alias("jaccard"))


def at_least(runs: DataFrame, lists: int = 2) -> DataFrame:
    """The runs of queries that so many sources answer."""
    return runs.join(runs.groupBy("qid").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= lists).select("qid"), "qid", "left_semi")


def outside(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """What of rows isn't in allowed: empty if it is a subset."""
    return rows.select(*keys).distinct().join(allowed.select(*keys).distinct(), keys, "left_anti")


def group_contrast(owned: DataFrame, qrels: DataFrame, first: str = "tail_supported", second: str = "isolated") -> DataFrame:
    """stratum, pairs, and the mean within-query difference of the first group less the second in judged share, relevant share of judged (over queries where both have judged ones, judged_pairs) and mean gain. Queries with one of the groups only don't count."""
    rows = owned.join(qrels, ["qid", "docid"], "left").groupBy("qid", "stratum", "group").agg(F.avg(F.col("grade").isNotNull().cast("int")).alias("judged"), F.avg(F.when(F.col("grade").isNotNull(), (F.col("grade") >= 2).cast("int"))).alias("relevant"), F.avg(F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1).alias("gain"))
    one = lambda name, p: rows.where(F.col("group") == name).select("qid", "stratum", *[F.col(c).alias(f"{p}_{c}") for c in ("judged", "relevant", "gain")])
    both = one(first, "a").join(one(second, "b"), ["qid", "stratum"])
    mean = lambda c: F.round(F.avg(F.col(f"a_{c}") - F.col(f"b_{c}")), 9)
    return both.groupBy("stratum").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.col("a_relevant") - F.col("b_relevant")).alias("judged_pairs"), *[mean(c).alias(c) for c in ("judged", "relevant", "gain")])


def owner_summary(owned: DataFrame, qrels: DataFrame) -> DataFrame:
    """owner, group, queries, n, judged, and visible_queries: of them those with a judged document."""
    rows = owned.join(qrels, ["qid", "docid"], "left")
    seen = F.when(F.col("grade").isNotNull(), F.col("qid"))
    return rows.groupBy("owner", "group").agg(F.count_distinct("qid").alias("queries"), F.count(F.lit(1)).alias("n"), F.count("grade").alias("judged"), F.count_distinct(seen).alias("visible_queries"))


def observation(runs: DataFrame, sources: list[str]) -> DataFrame:
    """qid, docid and the rank (from 1) in each source, null where it lacks the document."""
    return runs.groupBy("qid", "docid").agg(*[F.max(F.when(F.col("source") == s, F.col("rank") + 1)).alias(f"rank_{s}") for s in sources])


def membership_entropy(shares: list) -> Column:
    """Entropy of shares (columns), zero ones left out."""
    return sum((F.when(p > 1e-12, -p * F.ln(p + 1e-12)).otherwise(0.0) for p in shares), F.lit(0.0))


def retained_depths(runs: DataFrame, expected: dict[str, int], queries: int) -> DataFrame:
    """source, qid, problem: lists of another depth than expected, expected sources that a query lacks, unexpected ones; and one row without source and qid if the number of queries is wrong."""
    spark = runs.sparkSession
    want = spark.createDataFrame(sorted(expected.items()), "source string, want bigint")  # a parameter, a few rows
    have = runs.groupBy("source", "qid").agg(F.count(F.lit(1)).alias("n"))
    every = runs.select("qid").distinct()
    both = every.join(F.broadcast(want), F.lit(True)).join(have, ["source", "qid"], "full")
    problem = F.when(F.col("want").isNull(), "unexpected source").when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("want"), "depth")
    wrong = every.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != queries).select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("qid"), F.lit("queries").alias("problem"))
    return both.select("source", "qid", problem.alias("problem")).where("problem is not null").unionByName(wrong)
