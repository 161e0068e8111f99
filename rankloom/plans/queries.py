"""Every query over the supplied tables, and the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import exact
from rankloom.functions import text as text_functions
from rankloom.functions.tables import written
from rankloom.operators import bounds, consensus, features, fusion, metrics, rankers, ranking, sets, statistics
from rankloom.plans import workloads as W
from rankloom.sources import trec

SOURCES = W.SOURCES
WEIGHTS = {"revenue": 0.4, "quantity": 0.3, "orders": 0.2, "returned": 0.1}
LEXICAL, SPECIALIST = ["revenue", "quantity"], "returned"
TEAMS = {"money": ["revenue", "orders"], "volume": ["quantity", "orders", "returned"]}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return keep


def with_runs(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([W.RUNS_SQL, *ctes])} {body}"


def rank_sql(body: str, by: tuple[str, ...] = ("qid",), depth: int | None = None) -> str:
    keys = ", ".join(by)
    cut = f" WHERE rank0 < {depth}" if depth else ""
    return f"SELECT * FROM (SELECT {keys}, docid, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, docid) - 1 AS INT) AS rank0, score FROM (SELECT {keys}, docid, round(score, 10) AS score FROM ({body}))){cut}"


RRF = f"SELECT qid, docid, sum(1.0 / {len(SOURCES)} / (61.0 + rank)) AS score FROM runs GROUP BY qid, docid"
WEIGHTED = "SELECT qid, docid, sum(CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items()) + " END / (61.0 + rank)) AS score FROM runs GROUP BY qid, docid"


@query(with_runs(rank_sql(RRF)))
def rrf_vanilla(spark, d):
    return fusion.rrf(W.runs(spark, d))


@query(with_runs(rank_sql(WEIGHTED)))
def rrf_weighted(spark, d):
    return fusion.rrf(W.runs(spark, d), weights=WEIGHTS)


@query(with_runs(exact.exact_sql("runs"), exact.units_sql()))
def rrf_canonical_exact(spark, d):
    return exact.exact_rrf(W.runs(spark, d))


@query(with_runs("SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, sum(rank + 1), docid) - 1 AS INT) AS rank0, count(*) AS coverage, CAST(sum(rank + 1) AS BIGINT) AS rank_sum FROM runs GROUP BY qid, docid"))
def coverage_proxy(spark, d):
    return fusion.coverage_proxy(W.runs(spark, d))


_R = "CAST(rank + 1 AS HUGEINT)"


@query(with_runs(f"SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, sum({_R}), sum({_R} * {_R}) DESC, sum({_R} * {_R} * {_R}), sum({_R} * {_R} * {_R} * {_R}) DESC, docid) - 1 AS INT) AS rank0, count(*) AS coverage FROM runs GROUP BY qid, docid"))
def asymptotic_rrf(spark, d):
    return fusion.asymptotic_rrf(W.runs(spark, d))


@query(with_runs("SELECT qid, source, row_number() OVER (PARTITION BY qid, l ORDER BY list_position(['revenue', 'copy', 'quantity', 'orders', 'returned'], source)) = 1 AS kept FROM (SELECT qid, source, list(docid ORDER BY rank) AS l FROM (SELECT * FROM runs UNION ALL SELECT qid, 'copy', docid, rank, score FROM runs WHERE source = 'revenue') GROUP BY qid, source)"))
def duplicate_quotient(spark, d):
    runs = W.runs(spark, d)
    return fusion.duplicate_quotient(runs.unionByName(runs.where("source = 'revenue'").withColumn("source", F.lit("copy"))), ["revenue", "copy", *SOURCES[1:]])


_OPS = {"sum": "sum(x)", "max": "max(x)", "median": "median(x)", "geomean": "exp(avg(ln(x)))", "rank_prod": "0.0 - sum(ln(rank + 1))", "harmonic": "count(*) / sum(1 / x)", "sum_normalized": "sum(x) / sqrt(count(*))"}


@query(with_runs(rank_sql(" UNION ALL ".join(f"SELECT '{k}' AS op, qid, docid, {e} AS score FROM (SELECT *, 1.0 / (60 + rank)::DOUBLE AS x FROM runs) GROUP BY qid, docid" for k, e in _OPS.items()), ("op", "qid"))))
def aggregation_family(spark, d):
    return fusion.aggregation_family(W.runs(spark, d))


@query(with_runs(rank_sql(" UNION ALL ".join(f"SELECT CAST({k} AS DOUBLE) AS k, qid, docid, sum(1.0 / ({k} + rank)::DOUBLE) AS score FROM runs GROUP BY qid, docid" for k in fusion.GRID), ("k", "qid"))))
def k_sweep(spark, d):
    return fusion.k_sweep(W.runs(spark, d))


_NORM = """SELECT *, CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (score - lo) / (hi - lo) END AS mm, CASE WHEN sd < 1e-9 THEN 0.0 ELSE (score - mu) / sd END AS z
FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS mu, stddev_pop(score) OVER w AS sd FROM runs WINDOW w AS (PARTITION BY qid, source))"""
_P = "least(greatest(1 / (1 + exp(-z)), 1e-6), 1 - 1e-6)"
_L2 = "ln((1 / (1 + exp(2.0))) / (1 - 1 / (1 + exp(2.0))))"
_N = len(SOURCES)
for _m, _e in {"minmax": "sum(mm)", "z": f"sum(z) - 2.0 * ({_N} - count(*))", "z_fill0": "sum(z)", "rectz": "sum(greatest(z, 0.0))", "anz": "avg(z)", "logit": f"sum(ln({_P} / (1 - {_P}))) + ({_N} - count(*)) * {_L2}"}.items():
    query(with_runs(rank_sql(f"SELECT qid, docid, {_e} AS score FROM ({_NORM}) GROUP BY qid, docid")), "bayesian_logit" if _m == "logit" else "combanz" if _m == "anz" else f"combsum_{_m}")(lambda spark, d, m=_m: fusion.comb(W.runs(spark, d), m))


_JACCARD = """SELECT a.qid, a.source AS a, b.source AS b, round(o / (a.n + b.n - o + 1e-12), 9) AS jaccard FROM
(SELECT qid, source, count(*) AS n FROM runs WHERE rank < 30 GROUP BY ALL) a JOIN (SELECT qid, source, count(*) AS n FROM runs WHERE rank < 30 GROUP BY ALL) b ON a.qid = b.qid AND a.source < b.source
JOIN LATERAL (SELECT count(*) AS o FROM runs x JOIN runs y ON x.qid = y.qid AND x.docid = y.docid WHERE x.qid = a.qid AND x.source = a.source AND y.source = b.source AND x.rank < 30 AND y.rank < 30) ON true"""


@query(with_runs(_JACCARD))
def pairwise_jaccard(spark, d):
    return sets.pairwise_jaccard(W.runs(spark, d))


@query(with_runs("SELECT qid, round(0.0 - sum(p * ln(p)) / ln(4), 9) + 0.0 AS h_cov FROM (SELECT qid, c, m / sum(m) OVER (PARTITION BY qid) AS p FROM (SELECT qid, c, count(*) AS m FROM (SELECT qid, docid, count(*) AS c FROM runs WHERE rank < 100 GROUP BY ALL) GROUP BY ALL)) GROUP BY qid"))
def coverage_entropy(spark, d):
    return consensus.regime(W.runs(spark, d), SOURCES).select("qid", "h_cov")


@query(with_runs(consensus.regime_sql(SOURCES)))
def regime_alpha(spark, d):
    return consensus.regime(W.runs(spark, d), SOURCES)


for _v in ("v21", "v3", *consensus.VARIANTS, *consensus.ALPHA):
    query(with_runs(consensus.fuse_sql(SOURCES, _v)), {"v21": "v21_consensus", "v3": "v3_dgaf"}.get(_v, f"fuse_{_v}" if _v.startswith("ref_") else _v))(lambda spark, d, v=_v: consensus.fuse(W.runs(spark, d), SOURCES, v))


@query(with_runs(metrics.evaluate_sql(rank_sql(RRF))))
def metrics_rrf(spark, d):
    return metrics.evaluate(rrf_vanilla(spark, d), W.qrels(spark, d))


@query(with_runs(metrics.evaluate_sql("SELECT source, qid, docid, rank AS rank0 FROM runs", by=("source", "qid"))))
def metrics_by_source(spark, d):
    return metrics.evaluate(W.runs(spark, d).withColumnRenamed("rank", "rank0"), W.qrels(spark, d), ["source", "qid"])


_GRID = [i / 10 for i in range(11)]
_MIX = f"SELECT a.alpha, v.qid, v.docid, (1 - a.alpha) / (v.rank0 + 1) + a.alpha / (f.rank0 + 1) AS score FROM ({rank_sql(RRF)}) v JOIN ({consensus.fuse_sql(SOURCES, 'v5')}) f ON f.qid = v.qid AND f.docid = v.docid CROSS JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _GRID)}) AS a(alpha)"
_CURVE = f"SELECT alpha, qid, ndcg10 FROM ({metrics.evaluate_sql(rank_sql(_MIX, ('alpha', 'qid')), by=('alpha', 'qid'))})"


@query(with_runs(_CURVE))
def alpha_curve(spark, d):
    """NDCG@10 of mixtures of vanilla and v5 places, over a grid."""
    runs = W.runs(spark, d)
    v = fusion.rrf(runs).select("qid", "docid", F.col("rank0").alias("v"))
    f = consensus.fuse(runs, SOURCES, "v5").select("qid", "docid", F.col("rank0").alias("f"))
    rows = v.join(f, ["qid", "docid"]).select("qid", "docid", "v", "f", F.explode(F.array(*map(F.lit, _GRID))).alias("alpha"))
    mixed = ranking.ranking(rows.withColumn("score", (1 - F.col("alpha")) / (F.col("v") + 1) + F.col("alpha") / (F.col("f") + 1)), ["alpha", "qid"])
    return metrics.evaluate(mixed, W.qrels(spark, d), ["alpha", "qid"]).select("alpha", "qid", "ndcg10")


@query(with_runs(f"SELECT qid, min(alpha) AS best_alpha, max(best) AS ndcg10 FROM (SELECT *, max(ndcg10) OVER (PARTITION BY qid) AS best FROM ({_CURVE})) WHERE ndcg10 = best GROUP BY qid"))
def oracle_alpha(spark, d):
    return alpha_curve(spark, d).groupBy("qid").agg(F.max_by("alpha", F.struct("ndcg10", -F.col("alpha"))).alias("best_alpha"), F.max("ndcg10").alias("ndcg10"))


_PAIR = f"SELECT v.qid, v.ndcg10 AS vanilla, f.ndcg10 AS v5 FROM ({metrics.evaluate_sql(rank_sql(RRF))}) v JOIN ({metrics.evaluate_sql(consensus.fuse_sql(SOURCES, 'v5'))}) f ON f.qid = v.qid"


def _pair(spark, d, runs: DataFrame | None = None) -> DataFrame:
    """runs: these lists, where a caller has them already."""
    runs, qrels = W.runs(spark, d) if runs is None else runs, W.qrels(spark, d)
    one = lambda r, name: metrics.evaluate(r, qrels).select("qid", F.col("ndcg10").alias(name))
    return one(fusion.rrf(runs), "vanilla").join(one(consensus.fuse(runs, SOURCES, "v5"), "v5"), "qid")


@query(with_runs(f"SELECT qid, vanilla, v5, greatest(vanilla, v5) AS oracle FROM ({_PAIR})"))
def oracle_binary(spark, d):
    return _pair(spark, d).withColumn("oracle", F.greatest("vanilla", "v5"))


@query(with_runs(f"SELECT CASE WHEN vanilla > v5 THEN 'vanilla' WHEN vanilla < v5 THEN 'v5' ELSE 'tie' END AS winner, count(*) AS n FROM ({_PAIR}) GROUP BY 1"))
def winner_counts(spark, d):
    return features.winners(_pair(spark, d), "vanilla", "v5")


_TAIL = "t * exp(-x * x + " + " + t * (".join(str(c) for c in statistics.TAIL) + ")" * len(statistics.TAIL)
def ttest_sql(pairs: str) -> str:
    """The paired test over rows(pair, d)."""
    return f"""SELECT pair, n, round(m, 9) AS mean_diff, round(tt, 6) AS t, CASE WHEN n < 2 THEN 1.0 ELSE round({_TAIL}, 6) END AS p, wins, losses, ties
FROM (SELECT *, 1 / (1 + 0.5 * x) AS t FROM (SELECT *, abs(tt) / sqrt(2) AS x FROM (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE m / CASE WHEN v > 0 THEN sqrt(v / n) ELSE 1e-12 END END AS tt
FROM (SELECT pair, count(d) AS n, avg(d) AS m, var_samp(d) AS v, CAST(count(*) FILTER (d > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (d < 0) AS BIGINT) AS losses, CAST(count(*) FILTER (d = 0) AS BIGINT) AS ties FROM ({pairs}) GROUP BY pair))))"""


@query(with_runs(ttest_sql(f"SELECT 'v5-vanilla' AS pair, v5 - vanilla AS d FROM ({_PAIR})")))
def paired_ttest(spark, d):
    return statistics.paired_t(_pair(spark, d).select(F.lit("v5-vanilla").alias("pair"), F.col("v5").alias("a"), F.col("vanilla").alias("b")))


def _draw_sql(reps: int, seed: int, columns: str, source: str, placed: str = "placed") -> str:
    """rep and means of columns over drawn queries of source(qid, ...)."""
    means = ", ".join(f"avg({c}) AS {c}" for c in columns.split(", "))
    return f"SELECT rep, {means} FROM (SELECT rep, (((rep + 1) * 1103515245 + (pos + 1) * (rep + 7) * 12345 + {seed}) % 2147483648) % n AS i FROM range({reps}) r(rep) CROSS JOIN (SELECT i AS pos, count(*) OVER () AS n FROM {placed})) x JOIN {placed} USING (i) GROUP BY rep"


def _placed_sql(columns: str, source: str, placed: str = "placed") -> str:
    return f"{placed} AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, {columns} FROM ({source}))"


@query(with_runs(f"SELECT (SELECT count(*) FROM placed) AS n, round((SELECT avg(x) FROM placed), 9) AS mean, round(l[26], 9) AS low, round(l[975], 9) AS high FROM (SELECT list(x ORDER BY x) AS l FROM ({_draw_sql(1000, 42, 'x', '')}))", _placed_sql("x", f"SELECT qid, vanilla AS x FROM ({_PAIR})")))
def bootstrap_ci(spark, d):
    return statistics.bootstrap(_pair(spark, d).select("qid", F.col("vanilla").alias("x")))


@query(with_runs(f"SELECT n, mean_delta, round(l[101], 9) AS low, round(l[3901], 9) AS high, wins, losses, ties FROM (SELECT count(*) AS n, round(avg(delta), 9) AS mean_delta, CAST(count(*) FILTER (delta > 1e-12) AS BIGINT) AS wins, CAST(count(*) FILTER (delta < -1e-12) AS BIGINT) AS losses, CAST(count(*) FILTER (abs(delta) <= 1e-12) AS BIGINT) AS ties FROM placed) CROSS JOIN (SELECT list(delta ORDER BY delta) AS l FROM ({_draw_sql(4000, 1847, 'delta', '')}))", _placed_sql("delta", f"SELECT qid, v5 - vanilla AS delta FROM ({_PAIR})")))
def paired_bootstrap(spark, d):
    return statistics.paired_bootstrap(_pair(spark, d).select("qid", (F.col("v5") - F.col("vanilla")).alias("delta")))


_KVAL = f"SELECT k, qid, ndcg10 AS x FROM ({metrics.evaluate_sql(rank_sql(' UNION ALL '.join(f'SELECT CAST({k} AS DOUBLE) AS k, qid, docid, sum(1.0 / ({k} + rank)::DOUBLE) AS score FROM runs GROUP BY qid, docid' for k in fusion.GRID), ('k', 'qid')), by=('k', 'qid'))})"
_FOLDS = "SELECT qid, CAST((row_number() OVER (ORDER BY qid) - 1) % 3 AS INT) AS fold FROM (SELECT DISTINCT qid FROM runs)"


@query(with_runs("SELECT fold, k AS chosen, train, held_out FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, k) AS i FROM (SELECT fold, k, round((sum(sx) OVER (PARTITION BY k) - sx) / (sum(n) OVER (PARTITION BY k) - n), 9) AS train, round(sx / n, 9) AS held_out FROM (SELECT fold, k, sum(x) AS sx, count(x) AS n FROM kv JOIN fo ON fo.qid = kv.qid GROUP BY ALL))) WHERE i = 1", f"kv AS ({_KVAL})", f"fo AS ({_FOLDS})"))
def kfold_select_k(spark, d):
    values = metrics.evaluate(k_sweep(spark, d), W.qrels(spark, d), ["k", "qid"]).select("k", "qid", F.col("ndcg10").alias("x"))
    return statistics.select_in_folds(values, statistics.folds(W.runs(spark, d), 3), "k")


_TQ = f"SELECT qid, tq, rho, h_cov FROM ({consensus.regime_sql(SOURCES)})"


@query(with_runs(f"SELECT qid, CASE WHEN tq < 0.4 THEN 'easy' WHEN tq < 0.7 THEN 'medium' ELSE 'hard' END AS stratum FROM ({_TQ})"))
def tq_strata(spark, d):
    return statistics.strata(consensus.regime(W.runs(spark, d), SOURCES))


@query(with_runs(f"SELECT 'rho-delta' AS pair, count(*) AS n, round(1 - 6.0 * sum(power(ra - rb, 2)) / (count(*) * (count(*) * count(*) - 1)), 9) AS rho FROM (SELECT rank() OVER (ORDER BY rho) AS ra, rank() OVER (ORDER BY round(v5 - vanilla, 9)) AS rb FROM ({_PAIR}) p JOIN ({_TQ}) t ON t.qid = p.qid)"))
def spearman(spark, d):
    rows = _pair(spark, d).join(consensus.regime(W.runs(spark, d), SOURCES), "qid")
    return statistics.spearman(rows.select(F.lit("rho-delta").alias("pair"), "qid", F.col("rho").alias("a"), F.round(F.col("v5") - F.col("vanilla"), 9).alias("b")))


_SHARP = """SELECT qid, source, round(CASE WHEN n < 21 OR abs(s[1] - s[n // 2 + 1]) < 1e-9 THEN 0.5 ELSE greatest(0.0, least(2.0, (s[1] - s[least(20, n)]) / (s[1] - s[n // 2 + 1]))) / 2 END, 10) AS sharpness
FROM (SELECT qid, source, list(score ORDER BY score DESC) AS s, count(*) AS n FROM runs GROUP BY ALL)"""


@query(with_runs(_SHARP))
def sharpness_weights(spark, d):
    return fusion.sharpness(W.runs(spark, d))


@query(with_runs(rank_sql(f"SELECT r.qid, r.docid, sum(w / (61.0 + rank)) AS score FROM runs r JOIN (SELECT qid, source, exp(sharpness) / sum(exp(sharpness)) OVER (PARTITION BY qid) AS w FROM ({_SHARP})) s ON s.qid = r.qid AND s.source = r.source GROUP BY r.qid, r.docid")))
def sharpness_rrf(spark, d):
    return fusion.sharpness_rrf(W.runs(spark, d))


_ODDS = """SELECT source, bin, round(ln((rel + 1.0) / (n - rel + 1)), 10) AS log_odds, round(ln((sum(5 * rel) OVER (PARTITION BY source) + 1.0) / (sum(5 * n) OVER (PARTITION BY source) - sum(5 * rel) OVER (PARTITION BY source) + 1)), 10) AS marginal
FROM (SELECT source, CAST(rank // 5 AS INT) AS bin, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS rel, count(*) AS n FROM runs r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid WHERE rank < 50 GROUP BY ALL)"""


@query(with_runs(_ODDS))
def empirical_log_odds(spark, d):
    return fusion.empirical_log_odds(W.runs(spark, d), W.qrels(spark, d))


@query(with_runs(rank_sql("SELECT qid, docid, sum(log_odds - marginal) + (SELECT sum(m) FROM (SELECT max(marginal) AS m FROM o GROUP BY source)) AS score FROM runs r JOIN o ON o.source = r.source AND o.bin = r.rank // 5 WHERE rank < 50 GROUP BY qid, docid"), f"o AS ({_ODDS})"))
def empirical_fusion(spark, d):
    runs = W.runs(spark, d)
    return fusion.empirical_fusion(runs, fusion.empirical_log_odds(runs, W.qrels(spark, d)))


_SPEC = """SELECT qid, docid, owner, r AS owner_rank, CASE WHEN r <= 3 THEN 'rank1_3' ELSE 'rank4_10' END AS stratum, CASE WHEN n > 1 THEN 'tail_supported' ELSE 'isolated' END AS "group"
FROM (SELECT qid, docid, source AS owner, rank + 1 AS r, (SELECT count(*) FROM runs o WHERE o.qid = a.qid AND o.docid = a.docid) AS n FROM runs a WHERE rank < 10 AND NOT EXISTS (SELECT 1 FROM runs o WHERE o.qid = a.qid AND o.docid = a.docid AND o.source <> a.source AND o.rank < 30))"""


@query(with_runs(_SPEC))
def specialists(spark, d):
    return sets.specialists(W.runs(spark, d))


@query(with_runs(f'SELECT stratum, "group", count(*) AS n, count(grade) AS judged, round(count(grade) / count(*), 9) AS judged_share, round(sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) / nullif(count(grade), 0), 9) AS relevant_share, round(avg(power(2.0, coalesce(grade, 0)) - 1), 9) AS mean_gain FROM ({_SPEC}) s LEFT JOIN qrels q ON q.qid = s.qid AND q.docid = s.docid GROUP BY ALL'))
def tail_support(spark, d):
    return sets.group_outcomes(sets.specialists(W.runs(spark, d)), W.qrels(spark, d))


# lists that aren't cut before, so that every arm differs
WHOLE_SQL = W.RUNS_SQL.replace(f" WHERE rank < {W.DEPTH})", ")")
_ARMS = "SELECT *, min(n) OVER (PARTITION BY qid) AS least_n FROM (SELECT *, count(*) OVER (PARTITION BY qid, source) AS n FROM runs)"


@query(f"WITH {WHOLE_SQL} " + ("SELECT arm, qid, source, count(*) AS n, CAST(max(rank) AS INT) AS deepest FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, qid, source, rank FROM ({_ARMS}) WHERE {c}" for a, c in {"full": "true", "equalized": "rank < least_n", "top30": "rank < 30", "shared": "rank < least(least_n, 200)"}.items()) + ") GROUP BY ALL"))
def depth_arms(spark, d):
    return ranking.depth_arms(W.runs(spark, d, None)).groupBy("arm", "qid", "source").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("deepest"))


_K200 = "SELECT qid, docid, sum(0.25 / (201.0 + rank)) AS score FROM runs GROUP BY qid, docid"


@query(with_runs(f"SELECT qid, docid, o + 1 AS old_rank, n + 1 AS new_rank, CASE WHEN o IS NULL OR o >= 10 THEN 'entrant' WHEN n IS NULL OR n >= 10 THEN 'exit' ELSE 'reordered' END AS change FROM (SELECT a.qid, a.docid, a.rank0 AS o, b.rank0 AS n FROM ({rank_sql(RRF)}) a JOIN ({rank_sql(_K200)}) b ON a.qid = b.qid AND a.docid = b.docid) WHERE (o < 10 OR n < 10) AND o <> n"))
def transition(spark, d):
    runs = W.runs(spark, d)
    return ranking.transition(fusion.rrf(runs, 60), fusion.rrf(runs, 200))


@query(with_runs("SELECT qid FROM runs WHERE qid IN (SELECT qid FROM qrels WHERE grade > 0) GROUP BY qid HAVING count(DISTINCT source) = 4"))
def cohort(spark, d):
    return ranking.cohort(W.runs(spark, d), W.qrels(spark, d), list(SOURCES))


@query(with_runs("SELECT source, round(avg(rel), 9) AS mean_relevant10, round(avg(alone), 9) AS mean_unique FROM (SELECT r.qid, source, CAST(sum(CASE WHEN grade >= 2 AND rank < 10 THEN 1 ELSE 0 END) AS INT) AS rel, CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS INT) AS alone FROM (SELECT *, count(*) OVER (PARTITION BY qid, docid) AS c FROM runs WHERE rank < 30) r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid GROUP BY ALL) GROUP BY source"))
def diversity(spark, d):
    return sets.diversity(W.runs(spark, d), W.qrels(spark, d))


@query(with_runs("SELECT qid, source, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS tie_groups, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS tied_docs, CAST(sum(n - 1) AS BIGINT) AS tie_excess FROM (SELECT qid, source, score, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ALL"))
def tie_stats(spark, d):
    return sets.tie_statistics(W.runs(spark, d))


_RW = ", ".join(str(4**i * 5 ** (9 - i)) for i in range(10))
_SIDES = f"SELECT qid, docid, CAST(sum(c) AS BIGINT) AS coef, max(ra) AS ra, max(rb) AS rb FROM (SELECT qid, docid, -([{_RW}][rank + 1]) AS c, rank + 1 AS ra, NULL AS rb FROM runs WHERE source = 'revenue' AND rank < 10 UNION ALL SELECT qid, docid, [{_RW}][rank + 1], NULL, rank + 1 FROM runs WHERE source = 'orders' AND rank < 10) GROUP BY qid, docid"
_STATUS = "CASE WHEN lower > 0 THEN 'b_better' WHEN upper < 0 THEN 'a_better' WHEN lower = 0 AND upper = 0 THEN 'tie' ELSE 'unresolved' END"


def _list(runs: DataFrame, source: str) -> DataFrame:
    return runs.where(F.col("source") == source).select("qid", "docid", F.col("rank").alias("rank0"))


def _interval_sql(coef: str, gain: str, best: int, keys: str = "qid") -> str:
    return f"SELECT {keys}, CAST(k AS BIGINT) AS known, CAST(k + lo AS BIGINT) AS lower, CAST(k + hi AS BIGINT) AS upper, u AS unknown FROM (SELECT {', '.join('c.' + x if x == 'qid' else x for x in keys.split(', '))}, sum(CASE WHEN grade IS NULL THEN 0 ELSE coef * {gain} END) AS k, sum(CASE WHEN grade IS NULL THEN least(coef, 0) * {best} ELSE 0 END) AS lo, sum(CASE WHEN grade IS NULL THEN greatest(coef, 0) * {best} ELSE 0 END) AS hi, CAST(sum(CASE WHEN grade IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS u FROM ({coef}) c LEFT JOIN qrels q ON q.qid = c.qid AND q.docid = c.docid GROUP BY ALL)"


@query(with_runs(f"SELECT *, {_STATUS} AS status FROM ({_interval_sql(_SIDES, 'grade', 3)})"))
def rbp_bounds(spark, d):
    runs = W.runs(spark, d)
    return bounds.rbp_bounds(_list(runs, "revenue"), _list(runs, "orders"), W.qrels(spark, d))


_PLAN = f"SELECT qid, budget, count(*) AS pool, CAST(least(budget, count(*)) AS BIGINT) AS realized, CAST(sum(s) AS BIGINT) AS width, CAST(sum(CASE WHEN i > budget THEN s ELSE 0 END) AS BIGINT) AS by_influence, CAST(sum(CASE WHEN h > budget THEN s ELSE 0 END) AS BIGINT) AS by_head, CAST(sum(s) * (count(*) - least(budget, count(*))) AS BIGINT) AS by_chance, count(*) FILTER (i <= budget AND h <= budget) AS shared FROM (SELECT *, abs(coef) AS s, row_number() OVER (PARTITION BY qid ORDER BY abs(coef) DESC, docid) AS i, row_number() OVER (PARTITION BY qid ORDER BY least(coalesce(ra, 11), coalesce(rb, 11)), docid) AS h FROM ({_SIDES}) c WHERE NOT EXISTS (SELECT 1 FROM qrels q WHERE q.qid = c.qid AND q.docid = c.docid)) CROSS JOIN (VALUES (0), (1), (3)) AS b(budget) GROUP BY qid, budget"


@query(with_runs(_PLAN))
def acquisition_plan(spark, d):
    runs = W.runs(spark, d)
    return bounds.acquisition_plan(_list(runs, "revenue"), _list(runs, "orders"), W.qrels(spark, d))


_HEADS = f"SELECT qid, docid, CAST(sum(c) AS BIGINT) AS coef FROM (SELECT qid, docid, 1 AS c FROM ({rank_sql(RRF)}) WHERE rank0 < 10 UNION ALL SELECT qid, docid, -1 FROM runs WHERE source = 'returned' AND rank < 10) GROUP BY qid, docid HAVING sum(c) <> 0"
_SIGN = "CASE WHEN lower > 0 THEN 'strict_positive' WHEN upper < 0 THEN 'strict_negative' WHEN lower = 0 AND upper = 0 THEN 'point_zero' WHEN upper = 0 THEN 'nonpositive_with_zero' WHEN lower = 0 THEN 'nonnegative_with_zero' ELSE 'crosses_zero' END AS sign, CASE WHEN lower > 0 THEN 'all_completions_positive' WHEN upper <= 0 THEN 'positive_excluded' ELSE 'sign_unresolved' END AS decision"


@query(with_runs(f"SELECT *, {_SIGN} FROM ({_interval_sql(_HEADS, 'CASE WHEN grade > 0 THEN 1 ELSE 0 END', 1)})"))
def p10_bounds(spark, d):
    runs = W.runs(spark, d)
    return bounds.p10_bounds(fusion.rrf(runs).where("rank0 < 10"), _list(runs, "returned").where("rank0 < 10"), W.qrels(spark, d))


_TWO = rank_sql("SELECT qid, docid, sum(1.0 / (61.0 + rank)) AS score FROM runs WHERE source IN ('revenue', 'returned') GROUP BY qid, docid")
_EX = f"""SELECT f.qid, admitted, displaced FROM (SELECT qid, min_by(docid, rank) AS admitted FROM alone WHERE rank < 10 AND qid NOT IN (SELECT h.qid FROM hy h JOIN alone a ON a.qid = h.qid AND a.docid = h.docid WHERE rank0 < 10) GROUP BY qid) f
JOIN (SELECT qid, docid AS displaced FROM hy WHERE rank0 = 9) t ON t.qid = f.qid"""
_EX_CTES = (f"hy AS ({_TWO})", "alone AS (SELECT * FROM runs s WHERE source = 'returned' AND NOT EXISTS (SELECT 1 FROM runs a WHERE a.source = 'revenue' AND a.qid = s.qid AND a.docid = s.docid AND a.rank < 20))")


@query(with_runs(f"SELECT e.qid, admitted, displaced, CASE WHEN a.grade IS NULL OR b.grade IS NULL THEN 'unresolved' WHEN a.grade > 0 AND b.grade = 0 THEN 'rescue' WHEN a.grade = 0 AND b.grade > 0 THEN 'harm' ELSE 'neutral' END AS category FROM ({_EX}) e LEFT JOIN qrels a ON a.qid = e.qid AND a.docid = admitted LEFT JOIN qrels b ON b.qid = e.qid AND b.docid = displaced", *_EX_CTES))
def exchange_ledger(spark, d):
    runs = W.runs(spark, d)
    hybrid = fusion.rrf(runs.where("source in ('revenue', 'returned')"))
    return bounds.exchange_ledger(bounds.minority_exchange(_list(runs, "revenue").where("rank0 < 20"), _list(runs, "returned"), hybrid), W.qrels(spark, d))


_MEMBERS = ", ".join(f"('{t}', '{s}')" for t, ss in TEAMS.items() for s in ss)
_TEAM = f"SELECT * FROM ({rank_sql('SELECT team, qid, docid, sum(1.0 / (61.0 + rank)) AS score FROM runs JOIN teams ON teams.source = runs.source GROUP BY team, qid, docid', ('team', 'qid'))}) WHERE rank0 < 10"
_POOL = f"SELECT {{keys}}qid, docid, CAST(sum(c) AS BIGINT) AS coef FROM (SELECT team, qid, docid, 6 AS c FROM ({_TEAM}) UNION ALL SELECT team, qid, docid, -6 // (SELECT count(*) FROM teams x WHERE x.team = teams.team) FROM runs JOIN teams ON teams.source = runs.source WHERE rank < 10) GROUP BY ALL HAVING sum(c) <> 0"
_TEAMS_CTE = f"teams(team, source) AS (VALUES {_MEMBERS})"


def _team_bounds(spark, d, by):
    runs = W.runs(spark, d)
    teams = spark.createDataFrame([(t, s) for t, ss in TEAMS.items() for s in ss], "team string, source string")
    members = runs.join(F.broadcast(teams), "source")
    fused = ranking.ranking(members.groupBy("team", "qid", "docid").agg(F.sum(1 / (61 + F.col("rank"))).alias("score")), ["team", "qid"], 10)
    return bounds.team_bounds(members.where("rank < 10"), fused, W.qrels(spark, d), by)


@query(with_runs(_interval_sql(_POOL.format(keys="team, "), "CASE WHEN grade > 0 THEN 1 ELSE 0 END", 1, "team"), _TEAMS_CTE))
def team_fusion_bounds(spark, d):
    return _team_bounds(spark, d, ["team"])


@query(with_runs("SELECT known, lower, upper, unknown FROM (" + _interval_sql(f"SELECT 0 AS one, * FROM ({_POOL.format(keys='')})", "CASE WHEN grade > 0 THEN 1 ELSE 0 END", 1, "one") + ")", _TEAMS_CTE))
def pooled_fusion_bounds(spark, d):
    return _team_bounds(spark, d, [])


@query(with_runs(f"SELECT q.qid, CASE WHEN u AND s THEN 'U-and-S' WHEN u THEN 'U-only' WHEN s THEN 'S-only' ELSE 'neither' END AS partition, count(*) AS n FROM (SELECT q.qid, q.docid, EXISTS (SELECT 1 FROM runs r WHERE r.qid = q.qid AND r.docid = q.docid AND source IN ('revenue', 'quantity')) AS u, EXISTS (SELECT 1 FROM runs r WHERE r.qid = q.qid AND r.docid = q.docid AND source = 'returned') AS s FROM qrels q WHERE grade > 0) q GROUP BY ALL"))
def support_partition(spark, d):
    return sets.support_partition(W.runs(spark, d), W.qrels(spark, d), LEXICAL, SPECIALIST)


@query(with_runs("SELECT b.qid, t, v, coalesce(t > v, false) AS certified FROM (SELECT DISTINCT qid FROM runs) b LEFT JOIN (SELECT qid, x AS t FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, docid) AS i FROM u) WHERE i = 10) t ON t.qid = b.qid LEFT JOIN (SELECT qid, 1000000000000000 // (61 + min(rank)) + 1 AS v FROM runs s WHERE source = 'returned' AND NOT EXISTS (SELECT 1 FROM u WHERE u.qid = s.qid AND u.docid = s.docid) GROUP BY qid) v ON v.qid = b.qid", "u AS (SELECT qid, docid, CAST(sum(1000000000000000 // (61 + rank)) AS BIGINT) AS x FROM runs WHERE source IN ('revenue', 'quantity') GROUP BY qid, docid)"))
def exclusion_certificate(spark, d):
    return bounds.exclusion_certificate(W.runs(spark, d), LEXICAL, SPECIALIST)


_SX = "sx AS (SELECT qid, docid, CAST(sum(CASE WHEN source = 'revenue' THEN 100000000 // (61 + rank) ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN source = 'returned' THEN 100000000 // (61 + rank) ELSE 0 END) AS BIGINT) AS s FROM runs WHERE source IN ('revenue', 'returned') GROUP BY qid, docid), sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a + s DESC, docid) AS place FROM sx)"
_SPAIR = "SELECT x.qid, x.docid AS h, y.docid AS e, x.a - y.a AS den, y.s - x.s AS num, y.docid < x.docid AS strict FROM sr x JOIN sr y ON x.qid = y.qid AND x.place <= 10 AND y.place > 10"


def _end_sql(where: str, strict: str, order: str) -> str:
    exact = "(num::HUGEINT * 1000000000000000000 // den)"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {exact} {order}, {strict} {order}, num {order}, den {order}, h {order}, e {order}) AS i FROM sp WHERE {where}) WHERE i = 1"


_SCALAR = f"""SELECT q.qid, coalesce(l.num, 0) AS lower_num, coalesce(l.den, 1) AS lower_den, coalesce(l.strict, false) AS lower_strict, u.num AS upper_num, u.den AS upper_den, u.strict AS upper_strict, reason = 'feasible' AS feasible, reason, l.h AS lower_head, l.e AS lower_excluded, u.h AS upper_head, u.e AS upper_excluded
FROM (SELECT qid, bool_or(den = 0 AND (num > 0 OR num = 0 AND strict)) AS stuck FROM sp GROUP BY qid) q LEFT JOIN ({_end_sql('den > 0 AND num >= 0', 'strict', 'DESC')}) l ON l.qid = q.qid LEFT JOIN (SELECT qid, -num AS num, -den AS den, strict, h, e FROM ({_end_sql('den < 0', '(NOT strict)', 'ASC')})) u ON u.qid = q.qid
CROSS JOIN LATERAL (SELECT CASE WHEN q.stuck THEN 'zero_slope' WHEN u.num IS NULL OR coalesce(l.num, 0)::HUGEINT * u.den < u.num::HUGEINT * coalesce(l.den, 1) OR coalesce(l.num, 0)::HUGEINT * u.den = u.num::HUGEINT * coalesce(l.den, 1) AND NOT coalesce(l.strict, false) AND NOT u.strict THEN 'feasible' ELSE 'empty_interval' END AS reason)"""
_SCALAR_CTES = (_SX, f"sp AS ({_SPAIR})")


@query(with_runs(_SCALAR, *_SCALAR_CTES))
def scalar_interval(spark, d):
    """Weights of the revenue list against the returned list that give the fused head."""
    runs = W.runs(spark, d)
    unit = F.floor(F.lit(10**8) / (61 + F.col("rank"))).cast("bigint")
    one = lambda s: runs.where(F.col("source") == s).select("qid", "docid", unit.alias("x"))
    a, s = one("revenue"), one("returned")
    both = a.unionByName(s).groupBy("qid", "docid").agg(F.sum("x").alias("score"))
    return bounds.scalar_interval(ranking.ranking(both, None, 10), a, s)


_FEATURES_SQL = f"""SELECT t.qid, coalesce(n_unique, 0) AS n_unique, rho, h_cov, frac_specialist, frac_consensus, coalesce(mean_score_gap, 0.0) AS mean_score_gap, coalesce(max_score_gap, 0.0) AS max_score_gap, coalesce(top1_spread, 0.0) AS top1_spread, coalesce(score_var_mean, 0.0) AS score_var_mean, coalesce(mean_rank_dist, 0.0) AS mean_rank_dist FROM ({_TQ}) t
LEFT JOIN (SELECT qid, count(*) AS n_unique, round(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) / count(*), 9) AS frac_specialist, round(sum(CASE WHEN c = 4 THEN 1 ELSE 0 END) / count(*), 9) AS frac_consensus FROM (SELECT qid, docid, count(*) AS c FROM runs WHERE rank < 30 GROUP BY ALL) GROUP BY qid) c ON c.qid = t.qid
LEFT JOIN (SELECT qid, round(avg(top1 - mid), 6) AS mean_score_gap, round(max(top1 - mid), 6) AS max_score_gap, round(CASE WHEN count(*) >= 2 THEN max(top1) - min(top1) ELSE 0.0 END, 6) AS top1_spread, round(avg(sd), 6) AS score_var_mean FROM (SELECT qid, source, max(score) AS top1, median(score) AS mid, stddev_pop(score) AS sd FROM runs GROUP BY ALL HAVING count(*) >= 10) GROUP BY qid) s ON s.qid = t.qid
LEFT JOIN (SELECT qid, round(avg(dist), 9) AS mean_rank_dist FROM (SELECT a.qid, a.source AS sa, b.source AS sb, avg(abs(a.rank - b.rank)) AS dist FROM runs a JOIN runs b ON a.qid = b.qid AND a.docid = b.docid AND a.source < b.source WHERE a.rank < 50 AND b.rank < 50 GROUP BY ALL) GROUP BY qid) p ON p.qid = t.qid"""


@query(with_runs(_FEATURES_SQL))
def per_query_features(spark, d, runs=None):
    runs = W.runs(spark, d) if runs is None else runs
    return features.query_features(runs, consensus.regime(runs, SOURCES), len(SOURCES))


@query(with_runs(" UNION ALL ".join(f"SELECT '{k}' AS rule, CAST(sum(CASE WHEN {r.replace('D)', ')').replace('0D', '0').replace('5D', '5').replace('2D', '2').replace('1D', '1').replace('3D', '3').replace('4D', '4')} THEN 1 ELSE 0 END) AS BIGINT) AS n_true, count(*) AS n FROM f" for k, r in features.RULES.items()), f"f AS ({_FEATURES_SQL})"))
def route_rules(spark, d):
    return features.route(per_query_features(spark, d), features.RULES)


_MATCH = "q JOIN tf ON tf.term = q.term JOIN st ON st.term = q.term JOIN dl ON dl.docid = tf.docid CROSS JOIN tot"


def with_text(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([W.TEXT_SQL, *ctes])} {body}"


def _bm25_sql(k1: float, b: float, depth: int = W.DEPTH) -> str:
    return rank_sql(f"SELECT qid, tf.docid, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avg_dl))) AS score FROM {_MATCH} GROUP BY qid, tf.docid", ("qid",), depth)


def _collection(spark, d):
    return rankers.Collection(W.text_queries(spark, d), W.texts(spark, d))


@query(with_text(_bm25_sql(*rankers.BM25)))
def bm25(spark, d):
    return rankers.bm25(_collection(spark, d))


@query(with_text(_bm25_sql(*rankers.BM25_TUNED)))
def bm25_tuned(spark, d):
    return rankers.bm25(_collection(spark, d), *rankers.BM25_TUNED)


@query(with_text(rank_sql(f"SELECT qid, tf.docid, sum((1 + ln(tf)) * ln(n / (df + 1)::DOUBLE)) / sqrt(max(dl)) AS score FROM {_MATCH} GROUP BY qid, tf.docid", ("qid",), W.DEPTH)))
def tfidf(spark, d):
    return rankers.tfidf(_collection(spark, d))


@query(with_text(rank_sql("SELECT x.qid, x.docid, sum(ln((coalesce(tf, 0) + 2000.0 * cf / c) / (dl + 2000))) AS score FROM (SELECT DISTINCT q.qid, tf.docid FROM q JOIN tf ON tf.term = q.term) x JOIN q ON q.qid = x.qid JOIN st ON st.term = q.term JOIN dl ON dl.docid = x.docid LEFT JOIN tf ON tf.docid = x.docid AND tf.term = q.term CROSS JOIN tot GROUP BY x.qid, x.docid", ("qid",), W.DEPTH)))
def ql_dirichlet(spark, d):
    return rankers.ql_dirichlet(_collection(spark, d))


# the rankers of given candidates score BM25's list
_CAND = f"cand AS (SELECT qid, docid FROM ({_bm25_sql(*rankers.BM25)}))"
_F2 = "SELECT {k}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS f FROM {t}"
_BIGRAM = (
    f"df2 AS (SELECT docid, f, count(*) AS tf FROM ({_F2.format(k='docid', t='docs')}) GROUP BY ALL)",
    f"qf2 AS (SELECT qid, f, count(*) AS tf FROM ({_F2.format(k='qid', t='items')}) GROUP BY ALL)",
    "al AS (SELECT qid, cand.docid, f, tf FROM cand JOIN df2 ON df2.docid = cand.docid UNION ALL SELECT qid, '', f, tf FROM qf2)",
    "fd AS (SELECT *, (df >= 2 AND df < 0.95 * n) AS fit FROM (SELECT al.qid, f, count(*) AS df, max(n) AS n FROM al JOIN (SELECT qid, count(*) + 1 AS n FROM cand GROUP BY qid) c ON c.qid = al.qid GROUP BY al.qid, f))",
    "fw AS (SELECT qid, f, ln(n / (df + 1)::DOUBLE) AS idf FROM (SELECT *, bool_or(fit) OVER (PARTITION BY qid) AS fits FROM fd) WHERE fit OR NOT fits)",
    "ww AS (SELECT al.qid, al.docid, al.f, (1 + ln(tf)) * idf AS w FROM al JOIN fw ON fw.qid = al.qid AND fw.f = al.f)",
)


def _candidates(spark, d):
    return W.text_queries(spark, d), W.texts(spark, d), written(bm25(spark, d).select("qid", "docid"), "candidates")  # read several times


@query(with_text(rank_sql("SELECT c.qid, c.docid, coalesce(sum(d.w * q.w) / nullif(sqrt(sum(d.w * d.w)) * max(qn), 0), 0.0) AS score FROM cand c LEFT JOIN (SELECT * FROM ww WHERE docid <> '') d ON d.qid = c.qid AND d.docid = c.docid LEFT JOIN (SELECT * FROM ww WHERE docid = '') q ON q.qid = d.qid AND q.f = d.f LEFT JOIN (SELECT qid, sqrt(sum(w * w)) AS qn FROM ww WHERE docid = '' GROUP BY qid) z ON z.qid = c.qid GROUP BY c.qid, c.docid"), _CAND, *_BIGRAM))
def tfidf_bigram(spark, d):
    return rankers.bigram_cosine(*_candidates(spark, d))


_NEAR = """SELECT qid, docid, sum(1.0 / (1 + dist)) AS close FROM (SELECT x.qid, x.docid, x.i, y.i AS j, min(abs(x.pos - y.pos)) AS dist FROM fo x JOIN fo y ON x.qid = y.qid AND x.docid = y.docid AND x.i < y.i GROUP BY ALL) GROUP BY ALL"""
_PROX = f"""SELECT c.qid, c.docid, CASE WHEN len(d.raw) = 0 THEN 0.0 ELSE 0.2 * coalesce(have, 0) / m + 0.4 * coalesce(close, 0) / greatest(m * (m - 1) / 2, 1) + 0.15 * coalesce(early, 0) / m
+ 0.25 * CASE WHEN m < 2 THEN 0.0 WHEN contains(lower(d.text), query) THEN 1.0 ELSE least(1.0, 0.3 * len(list_filter(list_transform(range(1, m), lambda i: terms[i] || ' ' || terms[i + 1]), lambda p: contains(lower(d.text), p)))) END END AS score
FROM cand c JOIN te ON te.qid = c.qid JOIN docs d ON d.docid = c.docid
LEFT JOIN (SELECT qid, docid, count(*) AS have, sum(1.0 / (1 + first)) AS early FROM (SELECT qid, docid, i, min(pos) AS first FROM fo GROUP BY ALL) GROUP BY ALL) w ON w.qid = c.qid AND w.docid = c.docid
LEFT JOIN ({_NEAR}) p ON p.qid = c.qid AND p.docid = c.docid"""


@query(with_text(rank_sql(_PROX), _CAND, "te AS (SELECT qid, query, terms, len(terms) AS m FROM (SELECT qid, lower(text) AS query, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS terms FROM items))", "spots AS (SELECT docid, generate_subscripts(raw, 1) - 1 AS pos, unnest(raw) AS term FROM docs)", "fo AS (SELECT cand.qid, cand.docid, i, pos FROM cand JOIN (SELECT qid, generate_subscripts(terms, 1) AS i, unnest(terms) AS term FROM te) t ON t.qid = cand.qid JOIN spots ON spots.docid = cand.docid AND spots.term = t.term)"))
def proximity(spark, d):
    return rankers.proximity(*_candidates(spark, d))


@query()
def semantic_hash(spark, d):
    return rankers.semantic_hash(*_candidates(spark, d))


@query(with_runs("SELECT qid, source, docid, rank, score FROM runs"))
def trec_round_trip(spark, d):
    """Runs written as run lines and parsed again."""
    return trec.parse_runs(trec.format_runs(W.runs(spark, d)))


@query(with_runs("SELECT qid, docid, 'rank' AS problem FROM runs WHERE source = 'orders' AND rank > 4"))
def strict_run_violations(spark, d):
    """A run that skips a rank after its fifth document."""
    runs = W.runs(spark, d).where("source = 'orders'").withColumn("rank", F.col("rank") + F.when(F.col("rank") > 4, 1).otherwise(0))
    return trec.violations(trec.format_runs(runs, origin=1))


_TIMES = {"revenue": 1, "quantity": 1, "orders": 1, "returned": 3}
_TIMES_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _TIMES.items()) + " END"
@query(with_runs(exact.exact_sql("runs", times=_TIMES_SQL), exact.units_sql()))
def family_fusion(spark, d):
    """The mean of three lists plus a fourth, exactly."""
    return exact.exact_rrf(W.runs(spark, d), times=_TIMES)


_ARM_ROWS = [("P", s, 1) for s in SOURCES] + [("S", "returned", 1), ("A", "revenue", 1), ("A", "quantity", 1), ("B", "revenue", 1), ("B", "quantity", 1), ("B", "returned", 1), ("H", "revenue", 1), ("H", "returned", 1), ("copied", "revenue", 4), ("copied", "returned", 1)]
_ARM_SQL = rank_sql("SELECT arm, qid, docid, sum(copies / (61.0 + rank)) AS score FROM runs JOIN arms ON arms.source = runs.source GROUP BY arm, qid, docid", ("arm", "qid"))


def _arm_ranks(spark, d):
    return fusion.ensembles(W.runs(spark, d), spark.createDataFrame(_ARM_ROWS, "arm string, source string, copies int"))


@query(with_runs(f"SELECT arm, count(*) AS n, round(avg(ndcg10), 9) AS ndcg10, round(avg(map100), 9) AS map100, round(avg(mrr), 9) AS mrr FROM ({metrics.evaluate_sql(_ARM_SQL, by=('arm', 'qid'))}) GROUP BY arm", f"arms(arm, source, copies) AS (VALUES {', '.join(map(str, _ARM_ROWS))})"))
def ensemble_sweep(spark, d):
    """Five ensembles and one with copies of a list, evaluated together."""
    rows = metrics.evaluate(_arm_ranks(spark, d), W.qrels(spark, d), ["arm", "qid"])
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("ndcg10", "map100", "mrr")])


REPLICATES = 256
CLASSES_SQL = "s AS (SELECT r.qid, r.source, r.docid, r.rank, coalesce(grade, -1) AS grade, m.mask, CASE WHEN grade IS NULL THEN r.docid ELSE '' END AS fixed FROM runs r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid JOIN (SELECT qid, docid, string_agg(source, ',' ORDER BY source) AS mask FROM runs GROUP BY qid, docid) m ON m.qid = r.qid AND m.docid = r.docid)"
DRAWN_SQL = f"""SELECT r.rep, r.qid, r.source, r.docid, t.rank FROM (SELECT *, row_number() OVER (PARTITION BY rep, qid, source, grade, mask, fixed ORDER BY md5(CAST(rep AS VARCHAR) || ':' || docid), docid) AS place FROM s CROSS JOIN (SELECT CAST(range AS INT) AS rep FROM range({REPLICATES}))) r
JOIN (SELECT *, row_number() OVER (PARTITION BY qid, source, grade, mask, fixed ORDER BY rank) AS place FROM s) t ON t.qid = r.qid AND t.source = r.source AND t.grade = r.grade AND t.mask = r.mask AND t.fixed = r.fixed AND t.place = r.place"""


@query(with_runs(DRAWN_SQL, CLASSES_SQL))
def permutation_control(spark, d):
    return fusion.permutation_control(W.runs(spark, d), W.qrels(spark, d), REPLICATES)


@query(with_runs(f'SELECT "group", count(*) AS n, CAST(sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS relevant, CAST(sum(CASE WHEN grade IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, round(sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) / count(*), 9) AS lower, round(sum(CASE WHEN grade >= 2 OR grade IS NULL THEN 1 ELSE 0 END) / count(*), 9) AS upper FROM ({_SPEC}) s LEFT JOIN qrels q ON q.qid = s.qid AND q.docid = s.docid GROUP BY ALL'))
def specialist_share_bounds(spark, d):
    return bounds.share_bounds(sets.specialists(W.runs(spark, d)), W.qrels(spark, d))


@query(with_runs("SELECT source, count(*) AS n, " + ", ".join(f"CAST(sum(CASE WHEN rank < {k} AND grade IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS judged{k}, CAST(sum(CASE WHEN rank < {k} AND c = 1 THEN 1 ELSE 0 END) AS BIGINT) AS alone{k}, CAST(sum(CASE WHEN rank < {k} AND c = 1 AND grade IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS judged_alone{k}" for k in (10, 30)) + " FROM (SELECT *, count(*) OVER (PARTITION BY qid, docid) AS c FROM runs) r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid GROUP BY source"))
def observability(spark, d):
    return bounds.observability(W.runs(spark, d), W.qrels(spark, d))


@query(with_runs(consensus.explain_sql(SOURCES)))
def explain_v5(spark, d):
    return consensus.explain(W.runs(spark, d), SOURCES)


@query(with_runs(f"SELECT qid, CAST(sum(CASE WHEN grade IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS judged, count(*) AS n, round(sum(CASE WHEN grade IS NULL THEN 1 ELSE 0 END) / count(*), 9) AS unjudged_share FROM (SELECT r.qid, grade FROM ({rank_sql(RRF)}) r LEFT JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid WHERE rank0 < 10) GROUP BY qid"))
def judged_coverage(spark, d):
    rows = fusion.rrf(W.runs(spark, d)).where("rank0 < 10").join(W.qrels(spark, d), ["qid", "docid"], "left")
    n, judged = F.count(F.lit(1)), F.count("grade")
    return rows.groupBy("qid").agg(judged.alias("judged"), n.alias("n"), F.round((n - judged) / n, 9).alias("unjudged_share"))


_DEPTH_ARMS = {"full": "true", "equalized": "rank < least_n", "top30": "rank < 30"}
_BY_ARM = " UNION ALL ".join(f"SELECT '{a}' AS arm, {k} AS k, qid, docid, sum(1.0 / ({k}.0 + 1 + rank)) AS score FROM ({_ARMS}) WHERE {c} GROUP BY qid, docid" for a, c in _DEPTH_ARMS.items() for k in (60, 200))


@query(with_runs(f"SELECT arm, k, count(*) AS n, round(avg(ndcg10), 9) AS ndcg10 FROM ({metrics.evaluate_sql(rank_sql(_BY_ARM, ('arm', 'k', 'qid')), by=('arm', 'k', 'qid'))}) GROUP BY arm, k"))
def depth_intervention(spark, d):
    """Mean NDCG@10 of two smoothing constants on lists of different depth."""
    arms = ranking.depth_arms(W.runs(spark, d)).where("arm <> 'shared'").withColumn("k", F.explode(F.array(F.lit(60), F.lit(200))))
    fused = ranking.ranking(arms.groupBy("arm", "k", "qid", "docid").agg(F.sum(1 / (F.col("k") + 1 + F.col("rank"))).alias("score")), ["arm", "k", "qid"])
    return metrics.evaluate(fused, W.qrels(spark, d), ["arm", "k", "qid"]).groupBy("arm", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg10"), 9).alias("ndcg10"))


@query(with_runs("SELECT qid, source, docid, rank, CAST(score AS BIGINT)::VARCHAR || '.' || repeat('0', 39) || '1' AS score_text, false AS moved FROM runs"))
def exact_score_order(spark, d):
    """Scores of more than 38 digits, ranked exactly."""
    long = F.concat(F.col("score").cast("bigint").cast("string"), F.lit("." + "0" * 39 + "1"))
    lines = W.runs(spark, d).select(F.concat_ws(" ", "qid", F.lit("Q0"), "docid", F.col("rank").cast("string"), long, "source").alias("value"))
    return trec.rank_exact_scores(lines)


_TEXT_FN = f"SELECT doc_id, len({W.TOKENS_SQL}) AS n_tokens, len({W.RAW_SQL}) AS n_raw, greatest(length(text) - 3, 0) AS n_grams FROM documents"


@query(_TEXT_FN)
def token_counts(spark, d):
    docs = W.table(spark, d, "documents")
    return docs.select("doc_id", F.size(text_functions.tokenize(F.col("text"))).alias("n_tokens"), F.size(text_functions.tokenize_raw(F.col("text"))).alias("n_raw"), F.size(text_functions.char_ngrams(F.col("text"))).alias("n_grams"))


def queries() -> dict:
    from rankloom.plans import ablations, evidence, selectors  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
