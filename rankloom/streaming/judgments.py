"""Judgments that arrive over time: a running interval for each query, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "qid string, docid string, grade int, ts timestamp"


def read_judgments(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def running_bounds(judgments: DataFrame, coefficients: DataFrame, late: str = "1 day") -> DataFrame:
    """judgments (a stream) against static coefficients(qid, docid, coef) to qid, known, low, high: what is known so far, and how much of the interval's lower and upper part judgments have resolved. A pair counts once; late rows beyond the watermark are dropped from its state."""
    once = judgments.withWatermark("ts", late).dropDuplicatesWithinWatermark(["qid", "docid"])
    rows = once.join(coefficients, ["qid", "docid"])
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("qid").agg(F.sum(F.when(F.col("grade") > 0, F.col("coef")).otherwise(zero)).alias("known"), F.sum(F.least("coef", zero)).alias("low"), F.sum(F.greatest("coef", zero)).alias("high"))


def windowed_counts(judgments: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Judgments and relevant ones in each window of time."""
    return judgments.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("grade") > 0).cast("int")).alias("relevant"))
