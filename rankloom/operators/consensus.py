"""Iterative-consensus, document-gated, soft-routed and regime-aware fusion.

Runs are turned once into one row per query and document with a rank and a score column for each list; everything after that is a column expression or a window over the query, so a whole fusion costs the one shuffle by qid. Steps are layers of named SQL expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = "OVER (PARTITION BY qid)"
TOP, ROUNDS = 30, 4
D = 12

#: Fixed configurations of the soft-routed family, by name.
VARIANTS = {
    "v40": {},
    "v40_ref1": {"contribution_space": True},
    "v40_ref2": {"reliability": True},
    "v5": {"per_document": True},
    "v41": {"contribution_space": True, "reliability": True, "per_document": True},
    "v42_sig": {"contribution_space": True, "per_document": True, "one_sided_confidence": True, "one_sided_independence": True, "gate": "sigmoid"},
    "v42_relu": {"contribution_space": True, "per_document": True, "one_sided_confidence": True, "one_sided_independence": True, "gate": "relu"},
    "v42_brelu": {"contribution_space": True, "per_document": True, "one_sided_confidence": True, "one_sided_independence": True, "gate": "bounded"},
    "ref3_1side": {"per_document": True, "one_sided_confidence": True},
    "ref3_cgate": {"per_document": True, "one_sided_independence": True, "gate": "sigmoid"},
    "paca_k1": {"per_document": True, "protect": 1},
    "paca_k3": {"per_document": True, "protect": 3},
    "paca_k5": {"per_document": True, "protect": 5},
}


class Layers:
    """Named expressions in layers; a layer sees the columns of those before it."""

    def __init__(self):
        self.layers: list[list[tuple[str, str]]] = []

    def add(self, **named: str) -> None:
        """Literals become doubles; as decimals they would be divided with few digits."""
        self.layers.append([(name, re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", e)) for name, e in named.items()])

    def on(self, df: DataFrame) -> DataFrame:
        for layer in self.layers:
            df = df.selectExpr("*", *[f"{e} AS {name}" for name, e in layer])
        return df

    def sql(self, source: str) -> str:
        text = f"SELECT * FROM {source}"
        for layer in self.layers:
            text = f"SELECT *, {', '.join(f'{e} AS {name}' for name, e in layer)} FROM ({text})"
        return text


def wide(runs: DataFrame, sources) -> DataFrame:
    """qid, docid, p0.. (ranks) and s0.. (scores) of the lists in order; null where a list lacks the document."""
    one = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    return runs.groupBy("qid", "docid").agg(*[one(s, "rank").alias(f"p{i}") for i, s in enumerate(sources)], *[one(s, "score").alias(f"s{i}") for i, s in enumerate(sources)]).repartition("qid")


def wide_sql(sources, runs: str = "runs") -> str:
    cols = ", ".join(f"max(CASE WHEN source = '{s}' THEN {c} END) AS {c[0] if c == 'score' else 'p'}{i}" for i, s in enumerate(sources) for c in ("rank", "score"))
    return f"SELECT qid, docid, {cols} FROM {runs} GROUP BY qid, docid"


def clip(x: str, low: float, high: float) -> str:
    return f"least({high}, greatest({low}, {x}))"


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-{clip(x, -20.0, 20.0)})))"


def mean(xs: list[str], n: float | None = None) -> str:
    return f"(({' + '.join(xs)}) / {float(n or len(xs))})"


def spread(xs: list[str], floor: float = 0.0) -> list[str]:
    """Population z scores of a few columns."""
    m = mean(xs)
    sd = f"greatest({floor}, sqrt({mean([f'({x} - {m}) * ({x} - {m})' for x in xs])}))"
    return [f"(({x} - {m}) / {sd})" for x in xs]


def rrf_of(n: int, k: int, weights: list[str], lists=None) -> str:
    return "(" + " + ".join(f"coalesce({weights[r]} / ({k} + p{r} + 1), 0.0)" for r in (range(n) if lists is None else lists)) + ")"


def ranked(x: str) -> str:
    return f"(row_number() OVER (PARTITION BY qid ORDER BY round({x}, {D}) DESC, docid) - 1)"


def signals(b: Layers, n: int, top: int = TOP) -> None:
    """List sizes and overlaps in the heads, Jaccards, list confidences, disagreement tq and mean overlap rho."""
    pairs = [(r, s) for r in range(n) for s in range(r + 1, n)]
    b.add(**{f"n{r}": f"sum(CASE WHEN p{r} < {top} THEN 1 ELSE 0 END) {Q}" for r in range(n)}, **{f"o{r}_{s}": f"sum(CASE WHEN p{r} < {top} AND p{s} < {top} THEN 1 ELSE 0 END) {Q}" for r, s in pairs}, **{f"m{r}": f"avg(s{r}) {Q}" for r in range(n)})
    b.add(**{f"j{r}_{s}": f"(o{r}_{s} / (n{r} + n{s} - o{r}_{s} + 1e-12))" for r, s in pairs}, low_m=f"least({', '.join(f'm{r}' for r in range(n))})" if n > 1 else "m0", high_m=f"greatest({', '.join(f'm{r}' for r in range(n))})" if n > 1 else "m0")
    span = "CASE WHEN high_m - low_m > 1e-12 THEN high_m - low_m ELSE 1.0 END"
    js = [f"j{r}_{s}" for r, s in pairs] or ["1.0"]
    b.add(**{f"c{r}": f"0.3 + 0.4 * (m{r} - low_m) / ({span})" for r in range(n)}, tq="(" + " + ".join(f"(1.0 - {j})" for j in js) + f") / ({len(pairs)} + 1e-12)", rho=mean(js))


def jac(r: int, s: int) -> str:
    return f"j{min(r, s)}_{max(r, s)}"


def weights(b: Layers, n: int, k: int, trust: list[str], top: int = TOP, rounds: int = ROUNDS) -> list[str]:
    """Rounds of consensus: fuse, compare each list's head with the fused head, weigh anew. Returns the names of the last weights."""
    w = [f"{1.0 / n!r}"] * n
    for i in range(1, rounds + 1):
        b.add(**{f"f{i}": rrf_of(n, k, w)})
        b.add(**{f"fr{i}": ranked(f"f{i}")})
        agreement(b, n, f"fr{i}", f"a{i}_", top)
        am, cm, tm = mean([f"a{i}_{r}" for r in range(n)]), mean([f"c{r}" for r in range(n)]), mean(trust)
        b.add(**{f"x{i}_{r}": clip(f"{w[r]} * exp(1.2 * (a{i}_{r} - {am}) + 0.6 * (c{r} - {cm}) + 0.5 * ({trust[r]} - {tm}))", 0.05, 0.65) for r in range(n)})
        total = " + ".join(f"x{i}_{r}" for r in range(n))
        b.add(**{f"w{i}_{r}": f"x{i}_{r} / ({total} + 1e-12)" for r in range(n)})
        w = [f"w{i}_{r}" for r in range(n)]
    return w


def agreement(b: Layers, n: int, rank: str, name: str, top: int = TOP) -> None:
    b.add(**{f"{name}n": f"sum(CASE WHEN {rank} < {top} THEN 1 ELSE 0 END) {Q}"}, **{f"{name}o{r}": f"sum(CASE WHEN {rank} < {top} AND p{r} < {top} THEN 1 ELSE 0 END) {Q}" for r in range(n)})
    b.add(**{f"{name}{r}": f"{name}o{r} / (n{r} + {name}n - {name}o{r} + 1e-12)" for r in range(n)})


def v21(b: Layers, n: int, k: int = 60, top: int = TOP) -> None:
    """Consensus C, specialists S and their mixture final21."""
    unique = []
    for r in range(n):
        js = [jac(r, s) for s in range(n) if s != r] or ["0.0"]
        m = f"(({' + '.join(js)}) / ({n - 1} + 1e-12))"
        unique.append(f"tanh((({' + '.join(f'({j} - {m}) * ({j} - {m})' for j in js)}) / ({n - 1} + 1e-12)) / ({m} + 0.1))")
    b.add(**{f"u{r}": e for r, e in enumerate(unique)})
    w = weights(b, n, k, [f"u{r}" for r in range(n)], top)
    b.add(c_score=rrf_of(n, k, w))
    b.add(c_rank=ranked("c_score"))
    agreement(b, n, "c_rank", "ca_", top)
    b.add(**{f"l{r}": rrf_of(n, k, [f"({x} / ({' + '.join(w[j] for j in range(n) if j != r) or '1.0'} + 1e-12))" for x in w], [j for j in range(n) if j != r]) if n > 1 else "0.0" for r in range(n)})
    b.add(**{f"lr{r}": ranked(f"l{r}") for r in range(n)})
    b.add(**{f"lo{r}": f"sum(CASE WHEN c_rank < {top} AND lr{r} < {top} AND l{r} > 0 THEN 1 ELSE 0 END) {Q}" for r in range(n)}, **{f"ln{r}": f"sum(CASE WHEN lr{r} < {top} AND l{r} > 0 THEN 1 ELSE 0 END) {Q}" for r in range(n)})
    b.add(**{f"sp{r}": f"round(c{r} * (1.0 - lo{r} / (ca_n + ln{r} - lo{r} + 1e-12)) * (1 - ca_{r}) * u{r}, {D})" for r in range(n)})
    ahead = lambda r: " + ".join(f"(CASE WHEN sp{s} > sp{r} OR sp{s} = sp{r} AND {s} < {r} THEN 1 ELSE 0 END)" for s in range(n) if s != r) or "0"
    b.add(**{f"pick{r}": f"CASE WHEN {ahead(r)} < 2 THEN 1 ELSE 0 END" for r in range(n)})
    top_sp = "greatest(" + ", ".join([f"pick{r} * greatest(sp{r}, 1e-8)" for r in range(n)] + ["0.0"]) + ")"
    b.add(**{f"e{r}": f"pick{r} * exp((greatest(sp{r}, 1e-8) - {top_sp}) / 0.7)" for r in range(n)})
    total = " + ".join(f"e{r}" for r in range(n))
    b.add(**{f"sw{r}": f"e{r} / ({total} + 1e-12)" for r in range(n)})
    b.add(s_score=rrf_of(n, k, [f"sw{r}" for r in range(n)]))
    b.add(lam="0.10 + 0.45 * power(tq, 1.5)")
    b.add(final21="(1 - lam) * c_score + lam * s_score")


def moments_of(n: int, xs: list[str]) -> tuple[str, str, str]:
    """How many, mean and population deviation of a document's values over the lists that have it."""
    have = " + ".join(f"(CASE WHEN p{r} IS NULL THEN 0 ELSE 1 END)" for r in range(n))
    m = f"(({' + '.join(f'coalesce({x}, 0.0)' for x in xs)}) / ({have}))"
    return have, m, f"sqrt(({' + '.join(f'coalesce(({x} - {m}) * ({x} - {m}), 0.0)' for x in xs)}) / ({have}))"


def v3(b: Layers, n: int, k: int = 60) -> None:
    """After v21: a gate for each document says how far its specialists count; final3."""
    have, m, sd = moments_of(n, [f"p{r}" for r in range(n)])
    b.add(depth="greatest(" + ", ".join([f"coalesce(max(p{r}) {Q}, -1)" for r in range(n)] + ["-1"]) + ") + 1", s_rank=ranked("s_score"), have=f"({have})", sd_rank=sd, mean_rank=m)
    b.add(lift="greatest(0, c_rank - CASE WHEN s_score > 0 THEN s_rank ELSE depth END) / depth", disp=f"CASE WHEN have >= 2 THEN sd_rank / (mean_rank + {k}) ELSE 0.0 END")
    b.add(gate=sigmoid(f"(1.8 * (1 - have / {float(n)}) + 1.2 * disp + 1.3 * lift - 1.2)"))
    b.add(lam3="CASE WHEN s_score < 1e-6 THEN 0.05 ELSE 0.05 + 0.55 * power(tq, 1.5) * gate END")
    b.add(final3="(1 - lam3) * c_score + lam3 * s_score")


def soft_routed(b: Layers, n: int, k: int = 60, contribution_space=False, reliability=False, per_document=False, one_sided_confidence=False, one_sided_independence=False, gate=None, protect=0, alpha=0.5, beta=0.5, power=1.5, floor=0.1) -> None:
    """Lists weighted by consensus, each contribution modulated by how far the document is of consensus, disagreement or one specialist; final4."""
    b.add(**{f"ind{r}": f"(1.0 - ({' + '.join(jac(r, s) for s in range(n) if s != r) or '0.0'}) / ({n - 1} + 1e-12))" for r in range(n)})
    w = weights(b, n, k, [f"ind{r}" for r in range(n)])
    zc, zi = spread([f"c{r}" for r in range(n)], 1e-3), spread([f"ind{r}" for r in range(n)], 1e-3)
    b.add(**{f"zc{r}": zc[r] if n > 1 else "0.0" for r in range(n)}, **{f"zi{r}": (f"greatest(0.0, {zi[r]})" if one_sided_independence else zi[r]) if n > 1 else "0.0" for r in range(n)}, ae=f"{alpha} * power(tq, {power})", be=f"{beta} * power(tq, {power})", base=rrf_of(n, k, w))
    if per_document:
        b.add(**{f"cnt{r}": f"count(s{r}) {Q}" for r in range(n)}, **{f"z{r}": f"(s{r} - m{r}) / greatest(1e-3, stddev_pop(s{r}) {Q})" for r in range(n)}, **({"base_rank": ranked("base")} if protect else {}))
    have, m, sd = moments_of(n, [f"(1.0 / ({k} + p{r} + 1))" if contribution_space else f"p{r}" for r in range(n)])
    b.add(have4=f"({have})", m4=m, sd4=sd)
    b.add(disp4=f"CASE WHEN have4 >= 2 THEN sd4 / (m4 + {'1e-12' if contribution_space else k}) ELSE 0.0 END", cov=f"have4 / {float(n)}")
    b.add(total="cov * (1 - disp4) + cov * disp4 + (1 - cov) + 1e-12", pos=f"least(1.0, base_rank / {float(protect)})" if protect else "1.0")
    mods = {}
    for r in range(n):
        local = f"(CASE WHEN cnt{r} >= 2 THEN z{r} END)" if per_document else "NULL"
        listwide = f"1.0 + ae * zc{r} * pos"
        d = listwide
        if per_document:
            d = f"coalesce(1.0 + ae * {f'greatest(0.0, {local})' if one_sided_confidence else local} * pos, {listwide})"
            if one_sided_confidence:
                d = f"CASE WHEN cnt{r} >= 2 THEN 1.0 + ae * greatest(0.0, z{r}) * pos ELSE {listwide} END"
        s = f"1.0 + be * zi{r}"
        if reliability:
            s += f" * least(1.0, {w[r]} * {float(n)})"
        if gate:
            open_ = {"sigmoid": sigmoid(f"z{r}"), "relu": f"greatest(0.0, z{r})", "bounded": f"least(1.0, greatest(0.0, z{r}))"}[gate]
            s = f"1.0 + be * zi{r} * CASE WHEN cnt{r} >= 2 THEN {open_} ELSE 1.0 END"
        mods[f"mod{r}"] = f"greatest({floor}, cov * (1 - disp4) / total + cov * disp4 / total * ({d}) + (1 - cov) / total * ({s}))"
    b.add(**mods)
    b.add(final4=" + ".join(f"CASE WHEN p{r} IS NULL THEN 0.0 ELSE {w[r]} * mod{r} / ({k} + p{r} + 1) END" for r in range(n)))


def fusion_layers(name: str, n: int, k: int = 60) -> Layers:
    """Layers that end in a column final."""
    b = Layers()
    signals(b, n)
    if name in ("v21", "v3"):
        v21(b, n, k)
        if name == "v3":
            v3(b, n, k)
        b.add(final="final21" if name == "v21" else "final3")
        return b
    soft_routed(b, n, k, **VARIANTS["v5" if name.startswith("ref_") else name])
    if not name.startswith("ref_"):
        b.add(final="final4")
        return b
    b.add(van=rrf_of(n, k, [f"{1.0 / n!r}"] * n))
    b.add(van_rank=ranked("van"), v5_rank=ranked("final4"))
    entropy(b, n)
    b.add(delta="van_rank - v5_rank", alpha=ALPHA[name])
    if name == "ref_positional":
        norm = lambda x: f"CASE WHEN max({x}) {Q} - min({x}) {Q} < 1e-12 THEN 1.0 ELSE ({x} - min({x}) {Q}) / nullif(max({x}) {Q} - min({x}) {Q}, 0) END"
        b.add(v5_pos="1.0 / (v5_rank + 1)")
        b.add(v5_norm=norm("v5_pos"), van_norm=norm("van"))
        b.add(final="alpha * v5_norm + (1 - alpha) * van_norm")
    else:
        b.add(final="van * CASE WHEN delta > 0 THEN 1.0 + alpha * ln(1 + delta) * 0.10 ELSE 1.0 - alpha * ln(1 - delta) * 0.05 END")
    return b


#: How far the regime trusts v5, by name.
ALPHA = {
    "ref_scoremix": "least(1.0, greatest(0.0, (rho - 0.35) / 0.25))",
    "ref_positional": "least(1.0, greatest(0.0, (rho - 0.25) / 0.30))",
    "ref_logistic": "(1.0 / (1.0 + exp(-(rho - 0.42) / 0.08))) * (1.0 - 0.7 * h_cov)",
}


def entropy(b: Layers, n: int, depth: int = 100) -> None:
    """h_cov: entropy of how many lists hold a document of the heads, from 0 to 1."""
    b.add(held=" + ".join(f"(CASE WHEN p{r} < {depth} THEN 1 ELSE 0 END)" for r in range(n)))
    b.add(**{f"h{c}": f"sum(CASE WHEN held = {c} THEN 1.0 ELSE 0.0 END) {Q}" for c in range(1, n + 1)})
    total = " + ".join(f"h{c}" for c in range(1, n + 1))
    b.add(h_cov="(" + " + ".join(f"(CASE WHEN h{c} > 0 THEN -(h{c} / ({total})) * ln(nullif(h{c}, 0) / ({total})) ELSE 0.0 END)" for c in range(1, n + 1)) + f") / {__import__('math').log(n) if n > 1 else 1.0!r}")


def fuse(runs: DataFrame, sources, name: str, k: int = 60) -> DataFrame:
    """qid, docid, rank0, score by a named fusion: v21, v3, ref_scoremix, ref_positional, ref_logistic or one of VARIANTS."""
    from rankloom.operators.ranking import ranking

    rows = fusion_layers(name, len(sources), k).on(wide(runs, sources))
    return ranking(rows.select("qid", "docid", F.col("final").alias("score")))


def fuse_sql(sources, name: str, runs: str = "runs", k: int = 60) -> str:
    """The same by SQL on a table runs."""
    inner = fusion_layers(name, len(sources), k).sql(f"({wide_sql(sources, runs)})")
    return f"SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) - 1 AS INT) AS rank0, score FROM (SELECT qid, docid, round(final, 10) AS score FROM ({inner}))"


def regime(runs: DataFrame, sources) -> DataFrame:
    """qid, rho, h_cov, tq and the three alphas."""
    b = Layers()
    signals(b, len(sources))
    entropy(b, len(sources))
    b.add(**{f"alpha_{k[4:]}": v for k, v in ALPHA.items()})
    names = ["rho", "h_cov", "tq", *(f"alpha_{k[4:]}" for k in ALPHA)]
    return b.on(wide(runs, sources)).groupBy("qid").agg(*[F.round(F.max(c), 9).alias(c) for c in names])


def regime_sql(sources) -> str:
    b = Layers()
    signals(b, len(sources))
    entropy(b, len(sources))
    b.add(**{f"alpha_{k[4:]}": v for k, v in ALPHA.items()})
    names = ["rho", "h_cov", "tq", *(f"alpha_{k[4:]}" for k in ALPHA)]
    return f"SELECT qid, {', '.join(f'round(max({c}), 9) AS {c}' for c in names)} FROM ({b.sql(f'({wide_sql(sources)})')}) GROUP BY qid"


#: What explain() shows of a soft-routed fusion.
EXPLAINED = ("cov", "disp4", "tq", "ae", "base", "final4")


def explain(runs: DataFrame, sources, name: str = "v5", k: int = 60) -> DataFrame:
    """qid, docid and how its score came about: coverage, dispersion, disagreement, strength of modulation, the score before it and after, and each list's weight."""
    rows = fusion_layers(name, len(sources), k).on(wide(runs, sources))
    return rows.select("qid", "docid", *[F.round(c, 9).alias(c) for c in EXPLAINED], *[F.round(f"w{ROUNDS}_{r}", 9).alias(f"weight{r}") for r in range(len(sources))])


def explain_sql(sources, name: str = "v5", k: int = 60) -> str:
    inner = fusion_layers(name, len(sources), k).sql(f"({wide_sql(sources)})")
    return f"SELECT qid, docid, {', '.join(f'round({c}, 9) AS {c}' for c in EXPLAINED)}, {', '.join(f'round(w{ROUNDS}_{r}, 9) AS weight{r}' for r in range(len(sources)))} FROM ({inner})"
