"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so that at most 1 / HOT_SHARE keys are hot and may be broadcast.
HOT_SHARE = 1 / 2000
#: Rows in one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local runs only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/rankloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches short; texts have no bounded length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def skew_join(left: DataFrame, right: DataFrame, key: str, n_left: int, how: str = "left") -> DataFrame:
    """left joined to right, which has each key once. Hot keys of left (at most 1 / HOT_SHARE of them, a bound that holds at every size) go by a broadcast join, the others by a shuffle."""
    least = max(64, int(n_left * HOT_SHARE))
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least).select(key)
    rows = hot.collect()  # at most 1 / HOT_SHARE keys
    if not rows:
        return left.join(right, key, how)
    keys = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    some = left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, how)
    rest = left.join(keys, key, "left_anti").join(right.join(keys, key, "left_anti"), key, how)
    return some.unionByName(rest)
