"""All ensembles of some lists at once. An ensemble is a bit mask over the lists in their order, and a row says by its mask which ensemble it is of; so what belongs to a list alone, or to two of them, is computed once and shared by all ensembles that hold them, and a sweep is one plan however many ensembles it has. The number of lists is a parameter: n of them make 2**n - 1 ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import consensus as C
from rankloom.operators import fusion, metrics
from rankloom.operators.ranking import ranking

FUSIONS = ("rrf", "minmax", "z", "z_fill0", "rectz", "anz", "logit")


def masks(n: int, least: int = 1) -> list[int]:
    """The ensembles of at least so many of n lists."""
    return [m for m in range(1, 1 << n) if m.bit_count() >= least]


def _of(sources) -> Column:
    return F.coalesce(*[F.when(F.col("source") == s, F.lit(1 << i)) for i, s in enumerate(sources)])


def additive(runs: DataFrame, sources, least: int = 1, k: float = fusion.K) -> DataFrame:
    """fusion, mask, qid, docid, rank0, score of RRF and the six score fusions for every ensemble: a list's own part of a document's score goes to each ensemble with the list, and one aggregation sums them up. As with one ensemble alone, lists that a query lacks don't count among its lists."""
    rows = fusion.normalized(runs.where(F.col("source").isin(list(sources)))).withColumn("bit", _of(sources))
    have = F.bit_or("bit").over(Window.partitionBy("qid"))
    every = F.array(*map(F.lit, masks(len(sources), least)))
    each = rows.withColumn("have", have).withColumn("mask", F.explode(F.filter(every, lambda m: m.bitwiseAND(F.col("bit")) != 0)))
    n = F.bit_count(F.col("mask").bitwiseAND(F.col("have")))
    absent = F.max(n) - F.count(F.lit(1))
    clipped = lambda z: F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda z: F.ln(clipped(z) / (1 - clipped(z)))
    z = F.col("z")
    sums = {"rrf": F.sum(1 / n / (k + F.col("rank") + 1)), "minmax": F.sum("mm"), "z": F.sum(z) - 2 * absent, "z_fill0": F.sum(z), "rectz": F.sum(F.greatest(z, F.lit(0.0))), "anz": F.avg(z), "logit": F.sum(logit(z)) + absent * logit(F.lit(-2.0))}
    found = each.groupBy("mask", "qid", "docid").agg(*[e.cast("double").alias(f) for f, e in sums.items()])
    return ranking(found.unpivot(["mask", "qid", "docid"], list(FUSIONS), "fusion", "score"), ["fusion", "mask", "qid"])


def _on(r: int) -> str:
    return f"(mask & {1 << r}) <> 0"


def _total(xs: list[str]) -> str:
    """The sum over the ensemble's lists of an expression for each list."""
    return "(" + " + ".join(f"CASE WHEN {_on(r)} THEN {x} ELSE 0.0 END" for r, x in enumerate(xs)) + ")"


def _mean(xs: list[str]) -> str:
    return f"({_total(xs)} / n_on)"


def _spread(xs: list[str], floor: float) -> list[str]:
    m = _mean(xs)
    sd = f"greatest({floor}, sqrt({_mean([f'({x} - {m}) * ({x} - {m})' for x in xs])}))"
    return [f"CASE WHEN n_on > 1 THEN ({x} - {m}) / {sd} ELSE 0.0 END" for x in xs]


def _layers(n: int, k: int) -> tuple[C.Layers, C.Layers]:
    """Of regime-aware fusion, what lists and pairs of lists have in common for all ensembles, and what an ensemble makes of it."""
    pairs = [(r, s) for r in range(n) for s in range(r + 1, n)]
    top, one, own = C.TOP, range(n), "OVER (PARTITION BY qid, mask)"
    a = C.Layers()
    a.add(**{f"n{r}": f"sum(CASE WHEN p{r} < {top} THEN 1 ELSE 0 END) {C.Q}" for r in one}, **{f"o{r}_{s}": f"sum(CASE WHEN p{r} < {top} AND p{s} < {top} THEN 1 ELSE 0 END) {C.Q}" for r, s in pairs}, **{f"m{r}": f"avg(s{r}) {C.Q}" for r in one}, **{f"cnt{r}": f"count(s{r}) {C.Q}" for r in one}, **{f"z{r}": f"(s{r} - avg(s{r}) {C.Q}) / greatest(1e-3, stddev_pop(s{r}) {C.Q})" for r in one})
    if pairs:
        a.add(**{f"j{r}_{s}": f"(o{r}_{s} / (n{r} + n{s} - o{r}_{s} + 1e-12))" for r, s in pairs})
    b = C.Layers()
    b.add(n_on="bit_count(mask)", **{f"q{r}": f"CASE WHEN {_on(r)} THEN p{r} END" for r in one}, **{f"low{r}": f"CASE WHEN {_on(r)} THEN m{r} END" for r in one})
    both = lambda r, s: f"{_on(r)} AND {_on(s)}"
    n_pairs = "(n_on * (n_on - 1) / 2)"
    lows = [f"low{r}" for r in one]
    least, most = (f"least({', '.join(lows)})", f"greatest({', '.join(lows)})") if n > 1 else ("low0", "low0")
    b.add(low_m=least, high_m=most, tq="(" + " + ".join([f"CASE WHEN {both(r, s)} THEN 1.0 - j{r}_{s} ELSE 0.0 END" for r, s in pairs] + ["0.0"]) + f") / ({n_pairs} + 1e-12)", rho="CASE WHEN n_on < 2 THEN 1.0 ELSE (" + " + ".join([f"CASE WHEN {both(r, s)} THEN j{r}_{s} ELSE 0.0 END" for r, s in pairs] + ["0.0"]) + f") / greatest({n_pairs}, 1) END")
    span = "CASE WHEN high_m - low_m > 1e-12 THEN high_m - low_m ELSE 1.0 END"
    b.add(**{f"c{r}": f"0.3 + 0.4 * (m{r} - low_m) / ({span})" for r in one}, **{f"ind{r}": "1.0 - (" + " + ".join([f"CASE WHEN {_on(s)} THEN {C.jac(r, s)} ELSE 0.0 END" for s in one if s != r] + ["0.0"]) + ") / (n_on - 1 + 1e-12)" for r in one})
    w = ["(1.0 / n_on)"] * n
    rrf = lambda w: "(" + " + ".join(f"coalesce({w[r]} / ({k} + q{r} + 1), 0.0)" for r in one) + ")"
    ranked = lambda x: f"(row_number() OVER (PARTITION BY qid, mask ORDER BY round({x}, {C.D}) DESC, docid) - 1)"
    for i in range(1, C.ROUNDS + 1):
        b.add(**{f"f{i}": rrf(w)})
        b.add(**{f"fr{i}": ranked(f"f{i}")})
        b.add(**{f"an{i}": f"sum(CASE WHEN fr{i} < {top} THEN 1 ELSE 0 END) {own}"}, **{f"ao{i}_{r}": f"sum(CASE WHEN fr{i} < {top} AND q{r} < {top} THEN 1 ELSE 0 END) {own}" for r in one})
        b.add(**{f"a{i}_{r}": f"ao{i}_{r} / (n{r} + an{i} - ao{i}_{r} + 1e-12)" for r in one})
        am, cm, tm = _mean([f"a{i}_{r}" for r in one]), _mean([f"c{r}" for r in one]), _mean([f"ind{r}" for r in one])
        b.add(**{f"am{i}": am}, **({"cm": cm, "tm": tm} if i == 1 else {}))
        b.add(**{f"x{i}_{r}": f"CASE WHEN {_on(r)} THEN {C.clip(f'{w[r]} * exp(1.2 * (a{i}_{r} - am{i}) + 0.6 * (c{r} - cm) + 0.5 * (ind{r} - tm))', 0.05, 0.65)} ELSE 0.0 END" for r in one})
        b.add(**{f"w{i}_{r}": f"x{i}_{r} / ({' + '.join(f'x{i}_{s}' for s in one)} + 1e-12)" for r in one})
        w = [f"w{i}_{r}" for r in one]
    zc, zi = _spread([f"c{r}" for r in one], 1e-3), _spread([f"ind{r}" for r in one], 1e-3)
    have = " + ".join(f"(CASE WHEN q{r} IS NULL THEN 0 ELSE 1 END)" for r in one)
    b.add(**{f"zc{r}": zc[r] for r in one}, **{f"zi{r}": zi[r] for r in one}, ae="0.5 * power(tq, 1.5)", have=f"({have})", mu=f"(({' + '.join(f'coalesce(q{r}, 0.0)' for r in one)}) / nullif({have}, 0))", van=rrf(["(1.0 / n_on)"] * n))
    b.add(sd=f"sqrt(({' + '.join(f'coalesce((q{r} - mu) * (q{r} - mu), 0.0)' for r in one)}) / nullif(have, 0))")
    b.add(disp=f"CASE WHEN have >= 2 THEN sd / (mu + {k}) ELSE 0.0 END", cov="have / cast(n_on as double)")
    b.add(total="cov * (1 - disp) + cov * disp + (1 - cov) + 1e-12")
    mod = lambda r: f"greatest(0.1, cov * (1 - disp) / total + cov * disp / total * coalesce(1.0 + ae * CASE WHEN cnt{r} >= 2 THEN z{r} END, 1.0 + ae * zc{r}) + (1 - cov) / total * (1.0 + ae * zi{r}))"
    b.add(v5=" + ".join(f"CASE WHEN q{r} IS NULL THEN 0.0 ELSE {w[r]} * {mod(r)} / ({k} + q{r} + 1) END" for r in one))
    b.add(van_rank=ranked("van"), v5_rank=ranked("v5"))
    b.add(delta="van_rank - v5_rank", alpha=C.ALPHA["ref_scoremix"])
    b.add(final="van * CASE WHEN delta > 0 THEN 1.0 + alpha * ln(1 + delta) * 0.10 ELSE 1.0 - alpha * ln(1 - delta) * 0.05 END")
    return a, b


def regime_aware(runs: DataFrame, sources, least: int = 1, k: int = 60, whole: bool = False) -> DataFrame:
    """mask, qid, docid, rank0, score of regime-aware score mixing for every ensemble. whole: each ranks all documents of the query, those that none of its lists holds with score 0; else its own only. Head sizes, overlaps of pairs and scores within lists are windows over the query, computed before documents are dealt to ensembles; disagreement and mean overlap of an ensemble are then sums over its pairs, and its rounds of consensus are windows over query and ensemble, which the one shuffle by query serves."""
    n = len(sources)
    a, b = _layers(n, k)
    rows = a.on(C.wide(runs.where(F.col("source").isin(list(sources))), sources))
    held = sum((F.when(F.col(f"p{r}").isNotNull(), 1 << r).otherwise(0) for r in range(n)), F.lit(0))
    every = F.array(*map(F.lit, masks(n, least)))
    rows = rows.withColumn("held", held).withColumn("mask", F.explode(every if whole else F.filter(every, lambda m: m.bitwiseAND(F.col("held")) != 0)))
    return ranking(b.on(rows).select("mask", "qid", "docid", F.col("final").alias("score")), ["mask", "qid"])


def markov(runs: DataFrame, sources, least: int = 1, pool: int = 100, damping: float = 0.15, iterations: int = 80, tolerance: float = 1e-7) -> DataFrame:
    """mask, qid, docid, rank0, score of Markov chain fusion for every ensemble. Which documents a list holds and which of two it puts above the other are a matrix for each list; the matrices of an ensemble are those of the ensemble without its last list plus that list's, so each is added once for each ensemble. A query's pool is bounded by pool times the number of lists; no more matrices are held than there are lists."""
    import numpy as np
    import pandas as pd

    names = list(sources)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="docid", columns="source", values="rank").reindex(columns=names).sort_index()
        wide = wide[(wide < pool).any(axis=1)]
        ranks, out = wide.to_numpy(float), []

        def visit(r: int, mask: int, both, above) -> None:
            if r == len(names):
                inside = (ranks[:, [i for i in range(r) if mask >> i & 1]] < pool).any(axis=1)
                if mask.bit_count() >= least and inside.any():
                    score = fusion.stationary(both[np.ix_(inside, inside)], above[np.ix_(inside, inside)], damping, iterations, tolerance)
                    out.append(pd.DataFrame({"mask": mask, "qid": rows["qid"].iloc[0], "docid": wide.index[inside], "score": score}))
                return
            visit(r + 1, mask, both, above)
            more, higher = fusion.preferences(ranks[:, r])
            visit(r + 1, mask | 1 << r, both + more, above + higher)

        zero = np.zeros((len(wide), len(wide)))
        visit(0, 0, zero, zero)
        return pd.concat(out) if out else pd.DataFrame({"mask": [], "qid": [], "docid": [], "score": []})

    kept = runs.where(F.col("source").isin(names)).select("qid", "source", "docid", "rank")
    return ranking(kept.groupBy("qid").applyInPandas(one, "mask int, qid string, docid string, score double"), ["mask", "qid"])


def sweep(rankings: DataFrame, qrels: DataFrame, by: list[str]) -> DataFrame:
    """rankings(by, qid, docid, rank0) to by, size (how many lists the mask has), queries, ndcg10, mrr: means over queries."""
    rows = metrics.evaluate(rankings, qrels, [*by, "qid"])
    return rows.groupBy(*by).agg(F.bit_count(F.max("mask")).alias("size"), F.count(F.lit(1)).alias("queries"), F.round(F.avg("ndcg10"), 9).alias("ndcg10"), F.round(F.avg("mrr"), 9).alias("mrr"))
