"""Learned decay on queries that it hasn't seen: folds of one collection, and collections as a whole.

Counts are taken once, at all levels that an estimate needs, by grouping sets; what a held-out group leaves to learn from is its level's total less its own count, so no fold is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import fusion, metrics
from rankloom.operators.ranking import DIGITS, ranking

#: Ranks that are learned from, ranks in a bin, and the log odds of relevance where nothing was seen.
DEPTH, WIDTH, UNSEEN = 100, 5, 0.05


def held_out_counts(runs: DataFrame, qrels: DataFrame, of: DataFrame, depth: int = DEPTH, width: int = WIDTH, relevant: int = 2) -> DataFrame:
    """of(qid, collection, fold) to scope (within: the collection's other folds; cross: the other collections), collection, fold (null for cross), source, bin, rel, n: what each held-out group is learned from, also bins that only the held-out group has."""
    rows = runs.where(F.col("rank") < depth).join(of, "qid").join(qrels, ["qid", "docid"], "left")
    rows = rows.select("collection", "fold", "source", F.floor(F.col("rank") / width).cast("int").alias("bin"), (F.coalesce("grade", F.lit(0)) >= relevant).cast("bigint").alias("rel"))
    sums = rows.groupingSets([["source", "bin", "collection", "fold"], ["source", "bin", "collection"], ["source", "bin"]], "source", "bin", "collection", "fold").agg(F.sum("rel").alias("rel"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    one = lambda level, name: sums.where(F.col("level") == level).select(*["source", "bin", "collection", "fold"][: {0: 4, 1: 3, 3: 2}[level]], F.col("rel").alias(f"rel_{name}"), F.col("n").alias(f"n_{name}"))
    own, whole, every = one(0, "own"), one(1, "all"), one(3, "all")
    groups = of.select("collection", "fold").distinct()  # parameters
    rest = lambda c: F.col(f"{c}_all") - F.coalesce(f"{c}_own", F.lit(0).cast("bigint"))
    within = whole.join(F.broadcast(groups), "collection").join(own, ["source", "bin", "collection", "fold"], "left").select(F.lit("within").alias("scope"), "collection", "fold", "source", "bin", rest("rel").alias("rel"), rest("n").alias("n"))
    cross = every.join(F.broadcast(groups.select("collection").distinct()), F.lit(True)).join(whole.withColumnRenamed("rel_all", "rel_own").withColumnRenamed("n_all", "n_own"), ["source", "bin", "collection"], "left")
    return within.unionByName(cross.select(F.lit("cross").alias("scope"), "collection", F.lit(None).cast("int").alias("fold"), "source", "bin", rest("rel").alias("rel"), rest("n").alias("n")))


def held_out_odds(counts: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """counts with log_odds and marginal, smoothed by one: a bin counts once for each of its ranks in the marginal, a bin without rows has the marginal, and a group without any the odds of UNSEEN."""
    import math

    own = Window.partitionBy("scope", "collection", "fold", "source")
    wide = F.least(F.lit(width), F.lit(depth) - F.col("bin") * width)
    rel, n = F.sum(F.col("rel") * wide).over(own), F.sum(F.col("n") * wide).over(own)
    odds = lambda rel, n: F.ln((rel + 1) / (n - rel + 1))
    marginal = F.round(F.when(n > 0, odds(rel, n)).otherwise(math.log(UNSEEN / (1 - UNSEEN))), DIGITS)
    return counts.withColumn("marginal", marginal).withColumn("log_odds", F.when(F.col("n") > 0, F.round(odds(F.col("rel"), F.col("n")), DIGITS)).otherwise(F.col("marginal")))


def held_out_fusion(runs: DataFrame, odds: DataFrame, of: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """scope, collection, qid, docid, rank0, score: every query fused by the odds that were learned without it. A list that lacks a document gives its marginal."""
    rows = runs.where(F.col("rank") < depth).join(of, "qid").withColumn("bin", F.floor(F.col("rank") / width).cast("int"))
    absent = odds.select("scope", "collection", "fold", "source", "marginal").distinct()
    lists = runs.select("qid", "source").distinct().join(of, "qid")
    match = lambda a, b, *keys: [*[F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in ("collection", "source", *keys)], (F.col(f"{b}.scope") == "cross") | (F.col(f"{a}.fold") == F.col(f"{b}.fold"))]
    # tables of odds have a row for each held-out group, list and bin, parameters all
    every = lists.alias("l").join(F.broadcast(absent).alias("o"), match("l", "o")).groupBy("o.scope", "l.qid").agg(F.sum("o.marginal").alias("all"))
    said = odds.withColumn("more", F.col("log_odds") - F.col("marginal"))
    scores = rows.alias("r").join(F.broadcast(said).alias("o"), match("r", "o", "bin")).groupBy("o.scope", "r.collection", "r.qid", "r.docid").agg(F.sum("o.more").alias("more"))
    return ranking(scores.join(every, ["scope", "qid"]).select("scope", "collection", "qid", "docid", (F.col("more") + F.col("all")).alias("score")), ["scope", "collection", "qid"])


def evaluate_decay(runs: DataFrame, qrels: DataFrame, of: DataFrame, lists: int = 2) -> DataFrame:
    """scope, collection, qid, learned, vanilla: NDCG@10 of every query that so many lists answer, by odds that were learned without it and by RRF."""
    from rankloom.operators import sets

    runs = sets.at_least(runs, lists)
    learned = held_out_fusion(runs, held_out_odds(held_out_counts(runs, qrels, of)), of)
    found = metrics.evaluate(learned, qrels, ["scope", "collection", "qid"]).select("scope", "collection", "qid", F.col("ndcg10").alias("learned"))
    return found.join(metrics.evaluate(fusion.rrf(runs), qrels).select("qid", F.col("ndcg10").alias("vanilla")), "qid").select("scope", "collection", "qid", "learned", "vanilla")
