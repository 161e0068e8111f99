"""Whether a fusion's mechanisms do anything, and how far lists go their own ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import consensus as C

#: Fixed bounds of the verdicts, on the spread of modulations within a list and across a document's lists.
INERT, ALIVE = 0.003, 0.005
#: Shares of pairs in another order from which two lists are related, and independent.
RELATED, INDEPENDENT = 0.2, 0.4


def rank_distance(runs: DataFrame, depth: int = 200) -> DataFrame:
    """qid, a, b (sources), common (documents that both hold within depth), discordant (pairs of them in another order), distance (their share), band. Kendall's distance without pairs of documents: documents have places in b's order, and two are in another order if, at the highest bit in which their places differ, the one that a puts first has it set. So for each bit, among documents whose higher bits agree, every document without the bit counts those with it that a puts before: one running sum for each bit."""
    head = runs.where(F.col("rank") < depth)
    lists = head.groupBy("qid", "docid").agg(F.sort_array(F.collect_list(F.struct("source", "rank"))).alias("s"))
    pairs = lists.select("qid", "s", F.posexplode("s").alias("i", "a")).select("qid", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).select("qid", F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.rank").alias("ra"), F.col("b.rank").alias("rb"))
    of = ["qid", "a", "b"]
    placed = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy("rb")) - 1)
    bits = placed.withColumn("level", F.explode(F.array(*map(F.lit, range(max(depth - 1, 1).bit_length()))))).withColumn("bit", F.expr("shiftright(place, level) & 1")).withColumn("above", F.expr("shiftright(place, level + 1)"))
    before = F.sum("bit").over(Window.partitionBy(*of, "level", "above").orderBy("ra").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = bits.withColumn("before", F.when(F.col("bit") == 0, before).otherwise(0)).groupBy(*of).agg(F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("common"), F.sum("before").alias("discordant"))
    share = F.coalesce(F.col("discordant") / F.nullif(F.col("common") * (F.col("common") - 1) / 2, F.lit(0.0)), F.lit(0.0))
    band = F.when(share < RELATED, "alike").when(share < INDEPENDENT, "related").otherwise("independent")
    return sums.select(*of, "common", "discordant", F.round(share, 9).alias("distance"), band.alias("band"))


def _layers(n: int, name: str, k: int) -> C.Layers:
    """A soft-routed fusion's layers, and what its verdict is made of."""
    b = C.fusion_layers(name, n, k)
    have = " + ".join(f"(CASE WHEN p{r} IS NULL THEN 0 ELSE 1 END)" for r in range(n))
    b.add(**{f"g{r}": f"CASE WHEN p{r} IS NULL THEN NULL ELSE mod{r} END" for r in range(n)}, held_by=f"({have})")
    b.add(g_mean=f"(({' + '.join(f'coalesce(g{r}, 0.0)' for r in range(n))}) / held_by)")
    b.add(apart=f"CASE WHEN held_by >= 2 THEN sqrt(({' + '.join(f'coalesce((g{r} - g_mean) * (g{r} - g_mean), 0.0)' for r in range(n))}) / nullif(held_by - 1, 0)) END", pc="cov * (1 - disp4) / total", pd="cov * disp4 / total", ps="(1 - cov) / total")
    return b


def _summary(n: int) -> list[tuple[str, str]]:
    most = "greatest(" + ", ".join([f"coalesce(stddev_samp(g{r}), 0.0)" for r in range(n)] + ["0.0"]) + ")"
    return [("max_mod_std", most), ("mean_cross_std", "coalesce(avg(apart), 0.0)"), ("mean_pc", "avg(pc)"), ("mean_pd", "avg(pd)"), ("mean_ps", "avg(ps)"), *[(f"independence{r}", f"max(ind{r})") for r in range(n)]]


_VERDICT = f"CASE WHEN max_mod_std < {INERT} AND mean_cross_std < {INERT} THEN 'INERT' WHEN mean_cross_std < {ALIVE} THEN 'PER-DOC ONLY' ELSE 'FULLY ALIVE' END"


def mechanism(runs: DataFrame, sources, name: str = "v5", k: int = 60) -> DataFrame:
    """qid, max_mod_std (the greatest spread of one list's modulations over its documents), mean_cross_std (the mean spread over a document's lists), mean_pc, mean_pd, mean_ps (soft membership: consensus, disagreement, specialist), independence0.. (of each list: one less its mean overlap with the others), verdict. Spreads are those of samples."""
    n = len(sources)
    rows = _layers(n, name, k).on(C.wide(runs, sources)).groupBy("qid").agg(*[F.round(F.expr(e), 9).alias(c) for c, e in _summary(n)])
    return rows.withColumn("verdict", F.expr(_VERDICT))


def mechanism_sql(sources, name: str = "v5", k: int = 60) -> str:
    n = len(sources)
    inner = _layers(n, name, k).sql(f"({C.wide_sql(sources)})")
    return f"SELECT *, {_VERDICT} AS verdict FROM (SELECT qid, {', '.join(f'round({e}, 9) AS {c}' for c, e in _summary(n))} FROM ({inner}) GROUP BY qid)"
