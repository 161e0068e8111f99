"""Ranks, cuts and cohorts. Ties always go to the smaller docid, so every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 10


def rank_within(df: DataFrame, by: list[str], order: list[Column], depth: int | None = None, name: str = "rank") -> DataFrame:
    """A rank from 0 in each group; with depth only that many rows (Spark cuts them off before the shuffle)."""
    out = df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))
    return out if depth is None else out.where(F.col(name) < depth)


def ranking(scores: DataFrame, by: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """by (qid alone if not given), docid, score (rounded) to the same and rank0."""
    by = by or ["qid"]
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    return rank_within(rounded, by, [F.desc("score"), F.asc("docid")], depth, "rank0").select(*by, "docid", "rank0", "score")


def cohort(runs: DataFrame, qrels: DataFrame, sources: list[str]) -> DataFrame:
    """qid of the queries that all sources answer and that have a relevant document."""
    full = runs.where(F.col("source").isin(sources)).groupBy("qid").agg(F.count_distinct("source").alias("n")).where(F.col("n") == len(sources))
    return full.select("qid").join(qrels.where("grade > 0").select("qid").distinct(), "qid", "left_semi")


def judged(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """The rows of queries that have judgments; put before scoring, nothing is scored for the others."""
    return rows.join(qrels.select("qid").distinct(), "qid", "left_semi")


def depth_arms(runs: DataFrame, cap: int = 30, shared: int = 200) -> DataFrame:
    """arm, qid, source, docid, rank for the lists as they are, cut to the query's shortest, cut to cap, and cut to the shortest of them and shared."""
    least = F.min("n").over(Window.partitionBy("qid"))
    sized = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid", "source"))).withColumn("least", least)
    arms = F.array(
        F.lit("full"),
        F.when(F.col("rank") < F.col("least"), "equalized"),
        F.when(F.col("rank") < cap, f"top{cap}"),
        F.when(F.col("rank") < F.least(F.col("least"), F.lit(shared)), "shared"),
    )
    return sized.select(F.explode(F.array_compact(arms)).alias("arm"), "qid", "source", "docid", "rank")


def transition(old: DataFrame, new: DataFrame, cutoff: int = 10) -> DataFrame:
    """Two rankings(qid, docid, rank0) to the documents of either head whose place changed: qid, docid, old_rank, new_rank (from 1), change."""
    both = old.select("qid", "docid", (F.col("rank0") + 1).alias("old_rank")).join(new.select("qid", "docid", (F.col("rank0") + 1).alias("new_rank")), ["qid", "docid"], "full")
    was, now = F.coalesce(F.col("old_rank") <= cutoff, F.lit(False)), F.coalesce(F.col("new_rank") <= cutoff, F.lit(False))
    change = F.when(~was, "entrant").when(~now, "exit").otherwise("reordered")
    return both.where((was | now) & ~F.col("old_rank").eqNullSafe(F.col("new_rank"))).withColumn("change", change)
