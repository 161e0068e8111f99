"""Runs, judgments and candidate texts derived from the supplied tables.

The relational workload ranks suppliers for each part type by several integer scores, so that orders do not depend on the order of floating-point sums. The text workload ranks documents for each benchmark item, for all its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import STOPWORDS
from rankloom.operators.ranking import rank_within

SOURCES = ("revenue", "quantity", "orders", "returned")
DEPTH = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str, depth: int | None = DEPTH) -> DataFrame:
    """qid, source, docid, rank (from 0), score."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = items.join(parts, items.l_partkey == parts.p_partkey)
    sums = joined.groupBy(F.col("p_type").alias("qid"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("docid")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("revenue"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
    )
    long = sums.unpivot(["qid", "docid"], list(SOURCES), "source", "score")
    return rank_within(long, ["qid", "source"], [F.desc("score"), F.asc("docid")], depth).select("qid", "source", "docid", "rank", F.col("score").cast("double").alias("score"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, docid, grade 0..3; every fourth supplier is unjudged."""
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0")
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("qid")).distinct()
    grade = F.pmod(F.floor("s_acctbal") + F.length("qid"), F.lit(4)).cast("int")
    return types.join(suppliers.select("s_suppkey", "s_acctbal"), F.lit(True)).select("qid", F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("docid"), grade.alias("grade"))


def collection():
    """Part types in two collections, by whether their names are of odd or even length."""
    return F.when(F.length("qid") % 2 == 1, "odd").otherwise("even")


RUNS_SQL = f"""
sums AS (SELECT p_type AS qid, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS docid, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS orders, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
longer AS ({" UNION ALL ".join(f"SELECT qid, docid, '{s}' AS source, {s} AS score FROM sums" for s in SOURCES)}),
runs AS (SELECT qid, source, docid, rank, CAST(score AS DOUBLE) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, docid) - 1 AS INT) AS rank FROM longer) WHERE rank < {DEPTH}),
qrels AS (SELECT qid, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS docid, CAST((((CAST(floor(s_acctbal) AS BIGINT) + length(qid)) % 4) + 4) % 4 AS INT) AS grade
  FROM (SELECT DISTINCT p_type AS qid FROM part) CROSS JOIN supplier WHERE s_suppkey % 4 <> 0)
"""

def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, text of each benchmark item."""
    items = table(spark, sf_dir, "benchmark").where("item_id is not null")
    return items.select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("qid"), "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docid, text of every document."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("docid"), "text")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS_SQL = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x))"
RAW_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
TEXT_SQL = f"""
items AS (SELECT lpad(CAST(item_id AS VARCHAR), 6, '0') AS qid, text, {TOKENS_SQL} AS w, {RAW_SQL} AS raw FROM benchmark),
docs AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS docid, text, {TOKENS_SQL} AS w, {RAW_SQL} AS raw FROM documents),
q AS (SELECT qid, unnest(w) AS term FROM items),
post AS (SELECT docid, unnest(w) AS term FROM docs),
tf AS (SELECT docid, term, count(*) AS tf FROM post GROUP BY ALL), dl AS (SELECT docid, len(w) AS dl FROM docs),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term), tot AS (SELECT count(*) AS n, avg(dl) AS avg_dl, sum(dl) AS c FROM dl)
"""
