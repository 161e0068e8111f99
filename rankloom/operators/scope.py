"""Judgments of two phases, restricted to saved candidates. Judgments are many and candidates few, so a filter of bits (Bloom's) that holds all candidates goes to where judgments are read: it lets through all judged candidates and few others, before anything is shuffled, and the exact semi join decides what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each candidate, hashes, and bits at most, so that the filter never is over 8 MB; with more candidates it lets more through.
PER, HASHES, MOST = 10, 4, 1 << 26


def _places(keys: list[str], bits: int) -> Column:
    """The bits of a row: two hashes, combined."""
    a, b = F.xxhash64(*keys), F.xxhash64(F.lit(17), *keys)
    return F.array(*[F.pmod(a + F.lit(i) * F.pmod(b, F.lit(1 << 40)), F.lit(bits)) for i in range(HASHES)])


def bit_filter(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """One row: words, an array of longs whose bits are set for the keys of rows; and how many bits there are. Words are combined by or in every map task first."""
    n = rows.count()
    bits = 64
    while bits < min(MOST, PER * n):
        bits *= 2
    places = rows.select(F.explode(_places(keys, bits)).alias("at"))
    words = places.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
    laid = rows.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))
    return laid.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "v"))), lambda x: x["v"]).alias("words")), bits  # at most MOST / 64 longs


def might_hold(words: Column, keys: list[str], bits: int) -> Column:
    """Whether all bits of a row are set: always for a key of the filter, seldom for another."""
    word = lambda at: F.get(words, F.floor(at / 64).cast("int"))
    set_ = lambda at: F.call_function("shiftright", word(at), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return F.forall(_places(keys, bits), set_)


def scoped(labels: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("qid", "docid")) -> DataFrame:
    """The rows of labels whose keys are among candidates: by the filter first, then exactly."""
    keys = list(keys)
    saved = candidates.select(*keys).distinct()
    words, bits = bit_filter(saved, keys)
    maybe = labels.join(F.broadcast(words), F.lit(True)).where(might_hold(F.col("words"), keys, bits)).drop("words")
    return maybe.join(saved, keys, "left_semi")


def scope_ledger(candidates: DataFrame, early: DataFrame, late: DataFrame) -> DataFrame:
    """candidates(qid, docid), early and late (qid, docid, grade) to qid, candidates, early_global, late_global, early_scoped, late_scoped, and of the scoped ones added, revised and removed: what restricting both phases to the saved candidates leaves, and whether the later phase keeps what the first said."""
    saved = candidates.select("qid", "docid").distinct()
    count = lambda rows, name: rows.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    a, b = scoped(early, saved).select("qid", "docid", F.col("grade").alias("a")), scoped(late, saved).select("qid", "docid", F.col("grade").alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("bigint"))
    both = a.join(b, ["qid", "docid"], "full").groupBy("qid").agg(F.count("a").alias("early_scoped"), F.count("b").alias("late_scoped"), n(F.col("a").isNull()).alias("added"), n(F.col("a") != F.col("b")).alias("revised"), n(F.col("b").isNull()).alias("removed"))
    out = count(saved, "candidates").join(count(early, "early_global"), "qid", "left").join(count(late, "late_global"), "qid", "left").join(both, "qid", "left")
    return out.fillna(0)
