"""Effectiveness of rankings(qid, docid, rank0) against qrels(qid, docid, grade). Unjudged counts as 0 here; bounds.py keeps it unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gain(g):
    return F.pow(F.lit(2.0), g) - 1


def _discount(rank0):
    return F.ln(F.lit(2.0)) / F.ln(rank0 + 2.0)


def ideal(qrels: DataFrame, by_cut=(10, 20)) -> DataFrame:
    """qid, n_relevant and the ideal gain at each cut."""
    placed = qrels.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "docid")) - 1)
    cuts = [F.sum(F.when(F.col("i") < k, _gain(F.col("grade")) * _discount(F.col("i")))).alias(f"ideal{k}") for k in by_cut]
    return placed.groupBy("qid").agg(F.sum((F.col("grade") > 0).cast("int")).alias("n_relevant"), *cuts)


def evaluate(rankings: DataFrame, qrels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each query (and other columns of by): ndcg10, ndcg20, map100, mrr, p10, rbp10 (numerator over 3 * 5^10), judged10; queries without a relevant document are left out."""
    by = by or ["qid"]
    rows = rankings.join(qrels, ["qid", "docid"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    hits = F.sum((F.col("g") > 0).cast("int")).over(Window.partitionBy(*by).orderBy("rank0").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hits", hits)
    r, g = F.col("rank0"), F.col("g")
    dcg = lambda k: F.sum(F.when(r < k, _gain(g) * _discount(r)).otherwise(0.0))
    weight = F.element_at(F.array(*[F.lit(4**i * 5 ** (9 - i)).cast("bigint") for i in range(10)]), F.least(r, F.lit(9)).cast("int") + 1)
    sums = rows.groupBy(*by).agg(
        dcg(10).alias("dcg10"),
        dcg(20).alias("dcg20"),
        F.sum(F.when((g > 0) & (r < 100), F.col("hits") / (r + 1)).otherwise(0.0)).alias("ap"),
        F.min(F.when(g > 0, r)).alias("first"),
        F.sum(((g > 0) & (r < 10)).cast("int")).alias("hits10"),
        F.sum(F.when(r < 10, weight * g).otherwise(F.lit(0).cast("bigint"))).alias("rbp10_num"),
        F.sum((F.col("grade").isNotNull() & (r < 10)).cast("int")).alias("judged10"),
    )
    out = sums.join(ideal(qrels), "qid").where("n_relevant > 0")
    return out.select(
        *by,
        *[F.round(F.coalesce(F.col(f"dcg{k}") / F.nullif(F.col(f"ideal{k}"), F.lit(0.0)), F.lit(0.0)), 9).alias(f"ndcg{k}") for k in (10, 20)],
        F.round(F.col("ap") / F.col("n_relevant"), 9).alias("map100"),
        F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 9).alias("mrr"),
        F.round(F.col("hits10") / 10, 9).alias("p10"),
        "rbp10_num",
        "judged10",
    )


def evaluate_sql(rankings: str, qrels: str = "qrels", by: tuple[str, ...] = ("qid",)) -> str:
    keys = ", ".join(by)
    r_keys = ", ".join(f"r.{k}" for k in by)
    weights = ", ".join(str(4**i * 5 ** (9 - i)) for i in range(10))
    dcg = lambda k: f"sum(CASE WHEN rank0 < {k} THEN (power(2.0, g) - 1) * ln(2.0) / ln(rank0 + 2.0) ELSE 0.0 END)"
    idcg = lambda k: f"sum(CASE WHEN i < {k} THEN (power(2.0, grade) - 1) * ln(2.0) / ln(i + 2.0) END)"
    return f"""SELECT {", ".join(f"s.{k}" for k in by)}, round(coalesce(dcg10 / nullif(ideal10, 0), 0.0), 9) AS ndcg10, round(coalesce(dcg20 / nullif(ideal20, 0), 0.0), 9) AS ndcg20,
    round(ap / n_relevant, 9) AS map100, round(coalesce(1.0 / (first + 1), 0.0), 9) AS mrr, round(hits10 / 10.0, 9) AS p10, rbp10_num, judged10
    FROM (SELECT {keys}, {dcg(10)} AS dcg10, {dcg(20)} AS dcg20, sum(CASE WHEN g > 0 AND rank0 < 100 THEN hits / (rank0 + 1.0) ELSE 0.0 END) AS ap, min(CASE WHEN g > 0 THEN rank0 END) AS first,
      CAST(sum(CASE WHEN g > 0 AND rank0 < 10 THEN 1 ELSE 0 END) AS BIGINT) AS hits10, CAST(sum(CASE WHEN rank0 < 10 THEN [{weights}][least(rank0, 9) + 1] * g ELSE 0 END) AS BIGINT) AS rbp10_num,
      CAST(sum(CASE WHEN grade IS NOT NULL AND rank0 < 10 THEN 1 ELSE 0 END) AS BIGINT) AS judged10
      FROM (SELECT {r_keys}, r.docid, r.rank0, grade, coalesce(grade, 0) AS g, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {r_keys} ORDER BY rank0 ROWS UNBOUNDED PRECEDING) AS hits
        FROM ({rankings}) r LEFT JOIN {qrels} q ON q.qid = r.qid AND q.docid = r.docid) GROUP BY {keys}) s
    JOIN (SELECT qid, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS n_relevant, {idcg(10)} AS ideal10, {idcg(20)} AS ideal20
      FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) - 1 AS i FROM {qrels}) GROUP BY qid) t ON t.qid = s.qid WHERE n_relevant > 0"""


def report(rankings: dict[str, DataFrame], qrels: DataFrame, base: str | None = None) -> DataFrame:
    """variant, queries, mean metrics, and how NDCG@10 compares with that of base (the first if not given) query by query: difference, t, p, wins, losses, ties. One row for each ranking, in their order."""
    from rankloom.operators import statistics

    base = base or next(iter(rankings))
    names = ["ndcg10", "ndcg20", "map100", "mrr"]
    per = None
    for i, (name, ranking) in enumerate(rankings.items()):
        one = evaluate(ranking, qrels).select(F.lit(i).alias("nth"), F.lit(name).alias("variant"), "qid", *names)
        per = one if per is None else per.unionByName(one)
    means = per.groupBy("nth", "variant").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in names])
    own = per.where(F.col("variant") == base).select("qid", F.col("ndcg10").alias("b"))
    test = statistics.paired_t(per.join(own, "qid").select(F.col("variant").alias("pair"), F.col("ndcg10").alias("a"), "b"))
    return means.join(test.drop("n").withColumnRenamed("pair", "variant"), "variant").orderBy("nth").drop("nth")


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """bin (0 below low, bins + 1 from high on), n of values(column); empty bins have no row."""
    return values.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
