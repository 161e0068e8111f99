"""Queries about resampling and learned selectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.tables import written
from rankloom.operators import consensus, features, metrics, statistics
from rankloom.plans import evidence as E
from rankloom.plans import queries as Q
from rankloom.plans import workloads as W
from rankloom.plans.queries import query, with_runs

_ENDS = ", ".join(f"round(quantile_cont({c}, {p}), 9) AS {c}_{n}" for c in ("lower", "upper") for n, p in (("low", 0.025), ("high", 0.975)))
_BAND = "CASE WHEN lower_low > 0.1 THEN 'material_positive' WHEN upper_high < -0.1 THEN 'material_negative' WHEN lower_low >= -0.1 AND upper_high <= 0.1 AND upper_high - lower_low <= 0.1 THEN 'small_under_chosen_bound' ELSE 'inconclusive' END"


@query(with_runs(f"SELECT n, round(l, 9) AS lower, round(u, 9) AS upper, lower_low, lower_high, upper_low, upper_high, {_BAND} AS interpretation FROM (SELECT count(*) AS n, avg(lower) AS l, avg(upper) AS u FROM placed) CROSS JOIN (SELECT {_ENDS} FROM ({Q._draw_sql(10000, 42, 'lower, upper', '')}))", Q._placed_sql("lower, upper", f"SELECT qid, lower / 10 AS lower, upper / 10 AS upper FROM ({Q._interval_sql(Q._HEADS, E.BINARY, 1)})")))
def interval_envelope(spark, d):
    """Ends of P@10 bounds, resampled with the same draws."""
    rows = Q.p10_bounds(spark, d).select("qid", (F.col("lower") / 10).alias("lower"), (F.col("upper") / 10).alias("upper"))
    return statistics.envelope(rows)


@query(with_runs("SELECT qid, 'striped' AS how, CAST((row_number() OVER (ORDER BY qid) - 1) % 5 AS INT) AS fold FROM t UNION ALL SELECT qid, 'chunks', CAST(least((row_number() OVER (ORDER BY md5('42:' || qid) || qid) - 1) // (SELECT greatest(count(*) // 5, 1) FROM t), 4) AS INT) FROM t UNION ALL SELECT qid, 'shuffled', CAST((row_number() OVER (ORDER BY md5('42:' || qid) || qid) - 1) % 5 AS INT) FROM t", "t AS (SELECT DISTINCT qid FROM runs)"))
def fold_assignments(spark, d):
    runs = W.runs(spark, d)
    out = None
    for how in ("striped", "chunks", "shuffled"):
        one = statistics.folds(runs, 5, how).select("qid", F.lit(how).alias("how"), "fold")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_runs("SELECT qid, source, round(CASE WHEN count(*) OVER q < 2 THEN 0.0 ELSE (top - avg(top) OVER q) / greatest(stddev_pop(top) OVER q, 0.001) END, 9) + 0.0 AS z FROM (SELECT qid, source, max(score) AS top FROM runs GROUP BY ALL) WINDOW q AS (PARTITION BY qid)"))
def ranker_zscores(spark, d):
    """Each list's best score, standardised across the query's lists."""
    top = W.runs(spark, d).groupBy("qid", "source").agg(F.max("score").alias("top"))
    return statistics.zscores(top, "top").select("qid", "source", "z")


@query(with_runs(f"SELECT side, qid, round(delta, 9) AS delta, CAST(place AS INT) AS place FROM (SELECT 'worst' AS side, qid, delta, row_number() OVER (ORDER BY delta, qid) AS place FROM dl UNION ALL SELECT 'best', qid, delta, row_number() OVER (ORDER BY delta DESC, qid) FROM dl) WHERE place <= 5", f"dl AS (SELECT qid, round(v5 - vanilla, 9) AS delta FROM ({Q._PAIR}))"))
def extreme_deltas(spark, d):
    rows = Q._pair(spark, d).select("qid", F.round(F.col("v5") - F.col("vanilla"), 9).alias("delta"))
    return statistics.extremes(rows, "delta")


@query(with_runs(f"SELECT 'v5-vanilla' AS pair, count(delta) AS n, round(avg(delta), 9) AS mean, round(min(delta), 9) AS least, round(max(delta), 9) AS most, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (delta < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (delta = 0) AS BIGINT) AS zero FROM (SELECT v5 - vanilla AS delta FROM ({Q._PAIR}))"))
def paired_summary(spark, d):
    return statistics.paired_summary(Q._pair(spark, d).select(F.lit("v5-vanilla").alias("pair"), (F.col("v5") - F.col("vanilla")).alias("delta")))


_STD = ", ".join(f"round(({k} - avg({k}) OVER ()) / greatest(stddev_pop({k}) OVER (), 1e-6), 9) + 0.0 AS {k}" for k in features.KEYS)


@query(with_runs(f"SELECT qid, {_STD} FROM f", f"f AS ({Q._FEATURES_SQL})"))
def standardized_features(spark, d):
    rows = features.standardize(Q.per_query_features(spark, d))
    return rows.select("qid", *[(F.col(k) + 0.0).alias(k) for k in features.KEYS])


_AGG = ", ".join(x for k in features.KEYS for x in (f"round(avg({k}), 9) AS corpus_{k}_mean", f"round(stddev_pop({k}), 9) AS corpus_{k}_std"))


@query(with_runs(f"SELECT {E._GROUP} AS collection, {_AGG} FROM f GROUP BY 1", f"f AS ({Q._FEATURES_SQL})"))
def collection_aggregates(spark, d):
    names = [c for k in features.KEYS for c in (f"corpus_{k}_mean", f"corpus_{k}_std")]
    return features.collection_features(_rows(spark, d)).select("collection", *names).distinct()


_ALPHAS = Q._GRID
_LIST = f"SELECT qid, list(ndcg10 ORDER BY alpha) AS c FROM ({Q._CURVE}) GROUP BY qid"


@query(with_runs(f"SELECT qid, round(CASE WHEN t < 1e-9 THEN 0.5 ELSE s / t END, 9) AS target FROM (SELECT qid, list_sum(c) AS t, list_sum(list_transform(c, lambda x, i: x * (i - 1) / 10)) AS s FROM ({_LIST}))"))
def soft_alpha_targets(spark, d):
    return _curves(spark, d).select("qid", F.round(features.soft_target(F.col("curve"), _ALPHAS), 9).alias("target"))


@query(with_runs(f"SELECT CAST(CASE WHEN delta < -0.5 THEN 0 WHEN delta >= 0.5 THEN 11 ELSE floor((delta + 0.5) * 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT v5 - vanilla AS delta FROM ({Q._PAIR})) GROUP BY 1"))
def delta_histogram(spark, d):
    return metrics.histogram(Q._pair(spark, d).select((F.col("v5") - F.col("vanilla")).alias("delta")), "delta", -0.5, 0.5)


_LINES = {"rrf": Q.rank_sql(Q.RRF), "v5": consensus.fuse_sql(W.SOURCES, "v5"), "ref_scoremix": consensus.fuse_sql(W.SOURCES, "ref_scoremix")}
_REPORT = " UNION ALL ".join(f"SELECT '{k}' AS variant, * FROM ({metrics.evaluate_sql(v)})" for k, v in _LINES.items())


@query(with_runs(f"SELECT variant, count(*) AS queries, {', '.join(f'round(avg({c}), 4) AS {c}' for c in ('ndcg10', 'ndcg20', 'map100', 'mrr'))}, round(avg(ndcg10 - b), 9) AS mean_diff, CAST(count(*) FILTER (ndcg10 > b) AS BIGINT) AS wins, CAST(count(*) FILTER (ndcg10 < b) AS BIGINT) AS losses, CAST(count(*) FILTER (ndcg10 = b) AS BIGINT) AS ties FROM re JOIN (SELECT qid, ndcg10 AS b FROM re WHERE variant = 'rrf') USING (qid) GROUP BY variant", f"re AS ({_REPORT})"))
def fusion_report(spark, d):
    """The report of the command line, without its test statistic (paired_ttest has that)."""
    runs = W.runs(spark, d)
    rankings = {"rrf": Q.fusion.rrf(runs), **{k: consensus.fuse(runs, W.SOURCES, k) for k in ("v5", "ref_scoremix")}}
    return metrics.report(rankings, W.qrels(spark, d)).drop("t", "p")


# learned selectors: the same steps in SQL, unrolled pass by pass; tests also hold them against plain Python


def _fit_sql(rows: str, kind: str, keys, classes: int = 1, penalties=(0.10,), passes: int = 12) -> list[str]:
    """CTEs that end in found(seed, fold, l2, qid, held, p). A pass sums up each model's matrix with its slopes as last column; the matrix is solved by elimination, column after column."""
    d, n_out = len(keys), classes if kind == "classes" else 1
    size = (d + 1) * n_out
    x = [f"x[{i + 1}]" for i in range(d + 1)]
    z = ", ".join(f"{' + '.join(f'w[{i * n_out + k + 1}] * {x[i]}' for i in range(d + 1))} AS z{k}" for k in range(n_out))
    if kind == "classes":
        total = " + ".join(f"exp(z{k})" for k in range(n_out))
        p = ", ".join(f"exp(z{k}) / ({total}) AS p{k}" for k in range(n_out))
        slope = [f"p{k} - (target = {k})::INT" for k in range(n_out)]
        bend = lambda a, b: f"p{min(a, b)} * ({int(a == b)} - p{max(a, b)})"
        loss = f"ln({total}) - CASE target " + " ".join(f"WHEN {k} THEN z{k}" for k in range(n_out)) + " END"
    else:
        p = "1 / (1 + exp(-z0)) AS p0"
        if kind == "curve":
            at = "least(floor(p0 * (len(target) - 1))::INT, len(target) - 2)"
            line = f"(target[{at} + 1] - target[{at} + 2]) * (len(target) - 1)"
            loss = f"(target[{at} + 1] - target[{at} + 2]) * (p0 * (len(target) - 1) - {at}) - target[{at} + 1]"
        else:
            loss = {"label": "greatest(z0, 0) - z0 * target + ln(1 + exp(-abs(z0)))", "alpha": "power(p0 - target, 2) / 2"}[kind]
        slope = [{"label": "p0 - target", "alpha": "(p0 - target) * p0 * (1 - p0)"}.get(kind) or f"{line} * p0 * (1 - p0)"]
        bend = lambda a, b: {"label": "p0 * (1 - p0)", "alpha": "power(p0 * (1 - p0), 2)"}.get(kind) or f"abs({line}) * {features.BEND}"
    ctes = [
        f"fx AS MATERIALIZED ({rows})",
        "fh AS MATERIALIZED (SELECT DISTINCT seed, fold AS held FROM fx)",
        f"fs AS MATERIALIZED (SELECT fh.seed, held, {', '.join(f'avg({k}) AS m{i}, greatest(stddev_pop({k}), 1e-6) AS s{i}' for i, k in enumerate(keys))} FROM fh JOIN fx ON fx.seed = fh.seed AND fold <> held GROUP BY ALL)",
        f"ft AS MATERIALIZED (SELECT fx.seed, held, fold, qid, target, [{', '.join(f'({k} - m{i}) / s{i}' for i, k in enumerate(keys))}, 1.0::DOUBLE] AS x FROM fx JOIN fs ON fs.seed = fx.seed)",
        f"w0 AS MATERIALIZED (SELECT seed, held, l2::DOUBLE AS l2, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS good, 'infinity'::DOUBLE AS least, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS step FROM fh CROSS JOIN (VALUES {', '.join(f'({v})' for v in penalties)}) v(l2))",
    ]
    applied = lambda i: f"SELECT *, {p} FROM (SELECT ft.*, l2, w, good, least, step, {z} FROM w{i} JOIN ft ON ft.seed = w{i}.seed AND ft.held = w{i}.held)"
    where = [(i, k) for i in range(d + 1) for k in range(n_out)]
    cell = lambda i, a, j, b: f"sum(({bend(a, b)}) * {x[min(i, j)]} * {x[max(i, j)]}) / count(*)" + (f" + {'l2' if i < d else features.RIDGE}" if (i, a) == (j, b) else "")
    right = lambda i, a: f"sum(({slope[a]}) * {x[i]}) / count(*)" + (f" + l2 * w[{i * n_out + a + 1}]" if i < d else "")
    matrix = ", ".join("[" + ", ".join([*(cell(i, a, j, b) for j, b in where), right(i, a)]) + "]" for i, a in where)
    weight = " + ".join(f"w[{i * n_out + k + 1}] * w[{i * n_out + k + 1}]" for i in range(d) for k in range(n_out))
    keep = "seed, held, l2, w, good, least, step"
    for i in range(passes):
        text = f"SELECT {keep}, sum({loss}) / count(*) + l2 * ({weight}) / 2 AS loss, [{matrix}] AS h FROM ({applied(i)}) WHERE fold <> held GROUP BY {keep}"
        for c in range(1, size + 1):
            text = f"SELECT {keep}, loss, list_transform(h, lambda r, i: CASE WHEN i = {c} THEN list_transform(r, lambda v: v / r[{c}]) ELSE list_transform(r, lambda v, j: v - r[{c}] * h[{c}][j] / h[{c}][{c}]) END) AS h FROM ({text})"
        # a step that made the loss greater is halved, else the next one is taken
        text = f"SELECT seed, held, l2, CASE WHEN worse THEN good ELSE w END AS good, CASE WHEN worse THEN least ELSE loss END AS least, CASE WHEN worse THEN list_transform(step, lambda v: v / 2) ELSE list_transform(h, lambda r: r[{size + 1}]) END AS step FROM (SELECT *, loss > least + 1e-12 AS worse FROM ({text}))"
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT seed, held, l2, list_transform(good, lambda v, i: v - step[i]) AS w, good, least, step FROM ({text}))")
    said = ", ".join(f"round(p{k}, 6)" for k in range(n_out))
    ctes.append(f"found AS MATERIALIZED (SELECT seed, held AS fold, l2, qid, fold = held AS held, [{said}] AS p FROM ({applied(passes)}))")
    return ctes


def _runs(spark, d):
    """The lists, written once: a selector reads them for each of its fusions and features, and they are few beside the rows that they are summed from."""
    return written(W.runs(spark, d), "runs")


def _rows(spark, d, runs=None):
    """The features of each query and its collection."""
    return Q.per_query_features(spark, d, runs).withColumn("collection", W.collection())


def _folded(spark, d, rows):
    """rows for each seed with their folds."""
    out = None
    for seed in features.SEEDS:
        one = rows.join(statistics.folds(rows, 5, "chunks", seed), "qid").withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def _folded_sql(target: str, seeds=features.SEEDS, source: str = "f", more: str = "") -> str:
    """The features with targets (of pr, the values of each query) and the folds of each seed."""
    one = lambda seed: f"SELECT {seed} AS seed, least((row_number() OVER (ORDER BY md5('{seed}:' || qid) || qid) - 1) // (SELECT greatest(count(*) // 5, 1) FROM f), 4) AS fold, qid FROM f"
    return f"SELECT seed, fold, {source}.*, {target} AS target FROM {source} JOIN ({' UNION ALL '.join(map(one, seeds))}) USING (qid) JOIN pr USING (qid)"


def _curves(spark, d):
    rows = Q.alpha_curve(spark, d).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("alpha", "ndcg10"))).alias("c"))
    return rows.select("qid", F.transform("c", lambda x: x["ndcg10"]).alias("curve"))


def _three(spark, d, runs):
    """qid, vanilla, v5, v6: NDCG@10."""
    qrels = W.qrels(spark, d)
    return Q._pair(spark, d, runs).join(metrics.evaluate(consensus.fuse(runs, W.SOURCES, "ref_scoremix"), qrels).select("qid", F.col("ndcg10").alias("v6")), "qid")


_LABEL = "cast(v5 >= vanilla as int)"
_F, _PR = f"f AS MATERIALIZED ({Q._FEATURES_SQL})", f"pr AS MATERIALIZED ({Q._PAIR})"
_PR3 = f"pr AS MATERIALIZED (SELECT p.*, m.ndcg10 AS v6 FROM ({Q._PAIR}) p JOIN ({metrics.evaluate_sql(consensus.fuse_sql(W.SOURCES, 'ref_scoremix'))}) m ON m.qid = p.qid)"


@query(with_runs("SELECT qid, round(avg(CASE WHEN p[1] > 0.5 THEN v5 ELSE vanilla END), 9) AS chosen FROM found JOIN pr USING (qid) WHERE held GROUP BY qid", _F, _PR, *_fit_sql(_folded_sql("(v5 >= vanilla)::INT"), "label", features.KEYS)))
def pqas_selector(spark, d):
    """Chosen NDCG@10 of each query: a regression in five folds and five seeds decides between vanilla and v5."""
    runs = _runs(spark, d)
    values = written(Q._pair(spark, d, runs), "values")
    rows = written(_rows(spark, d, runs).join(values, "qid").withColumn("target", F.expr(_LABEL)).drop("vanilla", "v5"), "features")
    return features.route_by(features.cross_fit(_folded(spark, d, rows), "label"), values, features.two_way(F.col("vanilla"), F.col("v5")))


_BY_COLLECTION = f"SELECT 42 AS seed, dense_rank() OVER (ORDER BY {E._GROUP}) AS fold, f.*, (v5 >= vanilla)::INT AS target FROM f JOIN pr USING (qid)"
_TAKES = "p[1] > threshold"


@query(
    with_runs(
        f"SELECT *, row_number() OVER (PARTITION BY collection ORDER BY ndcg DESC, l2, threshold) = 1 AS best FROM (SELECT collection, l2, threshold, CAST(count(*) FILTER (held) AS BIGINT) AS queries, CAST(count(*) FILTER (held AND {_TAKES}) AS BIGINT) AS n_b, round(avg(CASE WHEN {_TAKES} THEN v5 ELSE vanilla END) FILTER (held), 9) AS ndcg, round(avg(CASE WHEN {_TAKES} THEN v5 ELSE vanilla END) FILTER (NOT held), 9) AS train_ndcg FROM found JOIN pr USING (qid) JOIN (SELECT DISTINCT fold, {E._GROUP} AS collection FROM fx) USING (fold) CROSS JOIN (VALUES {', '.join(f'({t}::DOUBLE)' for t in features.THRESHOLDS)}) t(threshold) GROUP BY ALL)",
        _F, _PR, *_fit_sql(_BY_COLLECTION, "label", features.KEYS, penalties=features.PENALTIES),
    )
)
def collection_selector(spark, d):
    """A grid of penalties and thresholds for a regression that never saw the collection it decides about."""
    rows = _rows(spark, d).join(Q._pair(spark, d).select("qid", F.col("vanilla").alias("a"), F.col("v5").alias("b")), "qid")
    return features.leave_one_out(rows)


_SOFT = "(SELECT CASE WHEN t < 1e-9 THEN 0.5 ELSE s / t END FROM (SELECT list_sum(c) AS t, list_sum(list_transform(c, lambda x, i: x * (i - 1) / 10)) AS s))"
_BEST = "(list_position(c, list_max(c)) - 1) / 10"
_ON_CURVE = "c[least(floor(a * 10)::INT, 9) + 1] * (1 - (a * 10 - least(floor(a * 10), 9))) + c[least(floor(a * 10)::INT, 9) + 2] * (a * 10 - least(floor(a * 10), 9))"


def _alpha_sql(name: str, kind: str, target: str, passes: int) -> str:
    ctes = _fit_sql(_folded_sql(target, features.SEEDS[:1]), kind, features.KEYS, passes=passes)
    return f"(WITH {', '.join(ctes)} SELECT qid, '{name}' AS loss, a AS alpha, round({_ON_CURVE}, 9) AS ndcg10 FROM (SELECT qid, p[1] AS a, c FROM found JOIN pr USING (qid) WHERE held))"


@query(with_runs(" UNION ALL ".join(_alpha_sql(*x) for x in (("best", "alpha", _BEST, 20), ("soft", "alpha", _SOFT, 20), ("direct", "curve", "c", 20))), _F, f"pr AS MATERIALIZED ({_LIST})"))
def alpha_selector(spark, d):
    """Predicted shares, and NDCG@10 there, of regressions to the best share, to a soft target, and on the curve itself."""
    curves = written(_curves(spark, d), "curves")
    alphas = F.array(*map(F.lit, _ALPHAS))
    best = curves.select("qid", F.element_at(alphas, F.array_position("curve", F.array_max("curve")).cast("int")).alias("best_alpha"))
    rows = _rows(spark, d).join(curves, "qid").join(best, "qid")
    rows = rows.join(statistics.folds(rows, 5, "chunks"), "qid").withColumn("seed", F.lit(features.SEEDS[0]))
    out = None
    for name, kind, target in (("best", "alpha", F.col("best_alpha")), ("soft", "alpha", features.soft_target(F.col("curve"), _ALPHAS)), ("direct", "curve", F.col("curve"))):
        found = features.cross_fit(rows.withColumn("target", target).drop("curve", "best_alpha"), kind, passes=20).where("held").join(curves, "qid")
        one = found.select("qid", F.lit(name).alias("loss"), F.col("p")[0].alias("alpha"), F.round(features.on_curve(F.col("curve"), _ALPHAS, F.col("p")[0]), 9).alias("ndcg10"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_runs("SELECT qid, round(avg(CASE list_position(p, list_max(p)) WHEN 1 THEN vanilla WHEN 2 THEN v5 ELSE v6 END), 9) AS chosen FROM found JOIN pr USING (qid) WHERE held GROUP BY qid", _F, _PR3, *_fit_sql(_folded_sql("list_position([vanilla, v5, v6], greatest(vanilla, v5, v6)) - 1"), "classes", features.KEYS, 3)))
def class_selector(spark, d):
    """Chosen NDCG@10 of each query by a regression of three classes."""
    runs = _runs(spark, d)
    values = written(_three(spark, d, runs), "values")
    likeliest = F.array_position(F.array("vanilla", "v5", "v6"), F.greatest("vanilla", "v5", "v6")) - 1
    rows = written(_rows(spark, d, runs).join(values, "qid").withColumn("target", likeliest.cast("int")).drop("vanilla", "v5", "v6"), "features")
    return features.route_by(features.cross_fit(_folded(spark, d, rows), "classes", classes=3), values, features.of_classes(F.col("vanilla"), F.col("v5"), F.col("v6")))


@query(with_runs("SELECT qid, round(avg(CASE WHEN p[1] > 0.35 AND p[1] < 0.65 THEN v6 WHEN p[1] > 0.5 THEN v5 ELSE vanilla END), 9) AS chosen FROM found JOIN pr USING (qid) WHERE held GROUP BY qid", _F, _PR3, *_fit_sql(_folded_sql("(v5 >= vanilla)::INT"), "label", features.KEYS, penalties=(0.30,))))
def cascade_selector(spark, d):
    """Chosen NDCG@10 of each query by the cascade of two: the third fusion where the regression trusts neither of the others."""
    runs = _runs(spark, d)
    values = written(_three(spark, d, runs), "values")
    rows = written(_rows(spark, d, runs).join(values, "qid").withColumn("target", F.expr(_LABEL)).drop("vanilla", "v5", "v6"), "features")
    return features.route_by(features.cross_fit(_folded(spark, d, rows), "label", penalties=(0.30,)), values, features.cascade(F.col("vanilla"), F.col("v5"), F.col("v6")))


_POOLED_KEYS = [*features.KEYS, *[f"corpus_{k}_{x}" for k in features.KEYS for x in ("mean", "std")]]
_POOLED = f"fp AS MATERIALIZED (SELECT f.*, a.* EXCLUDE (collection) FROM f JOIN (SELECT {E._GROUP} AS collection, {_AGG} FROM f GROUP BY 1) a ON a.collection = {E._GROUP})"


@query(with_runs("SELECT qid, round(avg(CASE WHEN p[1] > 0.5 THEN v5 ELSE vanilla END), 9) AS chosen FROM found JOIN pr USING (qid) WHERE held GROUP BY qid", _F, _PR, _POOLED, *_fit_sql(_folded_sql("(v5 >= vanilla)::INT", features.SEEDS[:1], "fp"), "label", _POOLED_KEYS)))
def pooled_selector(spark, d):
    """As pqas_selector, in one seed, with the collections' means and deviations as features too."""
    values = Q._pair(spark, d)
    rows = features.collection_features(_rows(spark, d)).join(values, "qid").withColumn("target", F.expr(_LABEL)).drop("vanilla", "v5")
    rows = rows.join(statistics.folds(rows, 5, "chunks"), "qid").withColumn("seed", F.lit(features.SEEDS[0]))
    return features.route_by(features.cross_fit(rows, "label", _POOLED_KEYS), values, features.two_way(F.col("vanilla"), F.col("v5")))
