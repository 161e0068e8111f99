"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local runs only; the session's own setting is left as it is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if (base := _LOCAL.get(spark.sparkContext.applicationId)) is None:
            base = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    return base.rstrip("/")


_LOCAL: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: cuts lineage, is read several times at the cost of once, and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/rankloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
