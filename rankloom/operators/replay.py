"""Whether a control keeps what it has to keep, and whether a run was replayed exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import exact


def class_masses(lists: DataFrame, qrels: DataFrame, sources: list[str], by: tuple[str, ...] = (), k: int = 60, depth: int = 200) -> DataFrame:
    """lists(by, qid, source, docid, rank) to by, qid, source, grade (-1 if unjudged), mask (which lists of sources hold the documents, a bit for each, combined by or), size, and the limbs l0.. of the sum of 1 / (k + rank + 1): the reciprocal mass of each class, exactly."""
    bit = F.coalesce(*[F.when(F.col("source") == s, F.lit(1 << i)) for i, s in enumerate(sources)])
    held = lists.groupBy(*by, "qid", "docid").agg(F.bit_or(bit).alias("mask"))
    rows = lists.join(held, [*by, "qid", "docid"]).join(qrels, ["qid", "docid"], "left").withColumn("grade", F.coalesce("grade", F.lit(-1)))
    keys = [*by, "qid", "source", "grade", "mask"]
    n = exact.limbs(k, depth)
    sums = rows.join(F.broadcast(exact.units(lists.sparkSession, k, depth)), "rank").groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(n)])
    return exact.carried(sums, n)


def invariants(natural: DataFrame, drawn: DataFrame, qrels: DataFrame, sources: list[str], k: int = 60, depth: int = 200) -> DataFrame:
    """qid, source, grade, mask, size, mass (limbs, highest first), replicates, kept (replicates of drawn in which the class has the same size and mass), and still (those in which all its documents have their natural ranks). Classes that only a replicate has, which no control may have, come with size 0."""
    n = exact.limbs(k, depth)
    mass = F.concat_ws(":", *[F.col(f"l{i}").cast("string") for i in reversed(range(n))])
    keys = ["qid", "source", "grade", "mask"]
    before = class_masses(natural, qrels, sources, (), k, depth).select(*keys, "size", mass.alias("mass"))
    after = class_masses(drawn, qrels, sources, ("rep",), k, depth).select("rep", *keys, F.col("size").alias("own"), mass.alias("got"))
    held = natural.select("qid", "source", "docid", F.col("rank").alias("was"))
    bit = F.coalesce(*[F.when(F.col("source") == s, F.lit(1 << i)) for i, s in enumerate(sources)])
    moved = drawn.join(held, ["qid", "source", "docid"]).join(natural.groupBy("qid", "docid").agg(F.bit_or(bit).alias("mask")), ["qid", "docid"]).join(qrels, ["qid", "docid"], "left").withColumn("grade", F.coalesce("grade", F.lit(-1)))
    moved = moved.groupBy("rep", *keys).agg(F.max((F.col("rank") != F.col("was")).cast("int")).alias("moved"))
    both = after.join(before, keys, "full").join(moved, ["rep", *keys], "left")
    same = (F.col("own") == F.col("size")) & (F.col("got") == F.col("mass"))
    return both.groupBy(*keys).agg(F.coalesce(F.max("size"), F.lit(0).cast("bigint")).alias("size"), F.max("mass").alias("mass"), F.count("rep").alias("replicates"), F.sum(F.coalesce(same.cast("bigint"), F.lit(0).cast("bigint"))).alias("kept"), F.sum(F.when(F.col("moved") == 0, 1).otherwise(0).cast("bigint")).alias("still"))


def digests(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, a, b: a digest of each group's rows as a multiset, whatever their order and partitions: sums of two hashes of whole rows, added up in every map task first."""
    columns = sorted(rows.columns)
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(2).alias("b"))


def replay(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """by, expected, observed (rows), missing, extra (rows, counted as often as they repeat), same: whether each group of two tables with the same columns holds the same rows. Only groups whose digests differ are compared row by row."""
    observed = observed.select(*expected.columns)
    left, right = digests(expected, by), digests(observed, by)
    both = left.select(*by, F.col("n").alias("expected"), "a", "b").join(right.select(*by, F.col("n").alias("observed"), F.col("a").alias("c"), F.col("b").alias("d")), by, "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    both = both.withColumn("same", F.coalesce((F.col("expected") == F.col("observed")) & (F.col("a") == F.col("c")) & (F.col("b") == F.col("d")), F.lit(False)))
    odd = both.where("not same").select(*by)
    some = lambda rows: rows.join(odd, by, "left_semi")
    count = lambda a, b, name: some(a).exceptAll(some(b)).groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = both.join(count(expected, observed, "missing"), by, "left").join(count(observed, expected, "extra"), by, "left")
    return out.select(*by, zero("expected").alias("expected"), zero("observed").alias("observed"), zero("missing").alias("missing"), zero("extra").alias("extra"), "same")
