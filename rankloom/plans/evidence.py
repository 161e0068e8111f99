"""Queries about judgments and intervals over the supplied tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import exact
from rankloom.functions import text as text_functions
from rankloom.operators import bounds, consensus, fusion, ranking, sets
from rankloom.plans import queries as Q
from rankloom.plans import workloads as W
from rankloom.plans.queries import query, with_runs
from rankloom.sources import trec

BINARY = "CASE WHEN grade > 0 THEN 1 ELSE 0 END"


# judgment files, as lines made from the judgments with some faults


def _faulty_lines(spark, d):
    """Judgment lines, with a fifth field, a grade 7, a pair twice and a bad round in places."""
    q = W.qrels(spark, d)
    at = F.length("docid") + F.substring("docid", -2, 2).cast("int")
    line = F.concat_ws(" ", F.regexp_replace("qid", " ", "_"), F.when(at % 7 == 0, "-1").otherwise("0.5"), "docid", F.when(at % 5 == 0, "7").otherwise(F.col("grade").cast("string")))
    rows = q.select(line.alias("value"), at.alias("at"))
    return rows.select("value").unionByName(rows.where("at % 11 = 0").select("value")).unionByName(rows.where("at % 13 = 0").select(F.concat("value", F.lit(" x")).alias("value")))


_AT = "(length(docid) + CAST(right(docid, 2) AS INT))"
_LINES = f"(SELECT replace(qid, ' ', '_') AS qid, docid, {_AT} AS spot FROM qrels)"


@query(with_runs(f"SELECT NULL AS qid, NULL AS docid, 'fields' AS problem FROM {_LINES} WHERE spot % 13 = 0 UNION ALL SELECT qid, docid, 'grade' FROM two WHERE spot % 5 = 0 UNION ALL SELECT qid, docid, 'duplicate' FROM two WHERE spot % 11 = 0 UNION ALL SELECT qid, docid, 'round' FROM two WHERE spot % 7 = 0", f"two AS (SELECT * FROM {_LINES} UNION ALL SELECT * FROM {_LINES} WHERE spot % 11 = 0)"))
def strict_qrels_violations(spark, d):
    return trec.qrels_violations(_faulty_lines(spark, d), rounds=True)


@query(with_runs("SELECT replace(qid, ' ', '_') AS qid, docid, CASE WHEN " + _AT.replace("docid", "docid") + " % 3 = 0 THEN CAST((grade + 1) % 4 AS INT) ELSE grade END AS grade FROM qrels"))
def last_judgment_wins(spark, d):
    """Judgment lines of which a third are given anew further down, read with line numbers."""
    q = W.qrels(spark, d)
    at = F.length("docid") + F.substring("docid", -2, 2).cast("int")
    qid = F.regexp_replace("qid", " ", "_")
    line = lambda g: F.concat_ws(" ", qid, F.lit("0"), "docid", g.cast("string"))
    first = q.select(line(F.col("grade")).alias("value"), F.lit(1).alias("line_no"))
    again = q.where(at % 3 == 0).select(line((F.col("grade") + 1) % 4).alias("value"), F.lit(2).alias("line_no"))
    return trec.parse_qrels(first.unionByName(again))


@query(with_runs("SELECT DISTINCT docid FROM runs"))
def docid_inventory(spark, d):
    return trec.parse_inventory(W.runs(spark, d).select(F.concat(F.lit(" "), "docid").alias("value")))


@query(with_runs("SELECT source, replace(qid, ' ', '_') AS qid, docid, problem FROM (SELECT source, qid, docid, 'tag' AS problem FROM runs WHERE source = 'orders' AND rank = 3 UNION ALL SELECT source, qid, docid, 'rank' FROM runs WHERE source = 'returned' AND rank = 0 UNION ALL SELECT source, qid, docid, 'document' FROM runs WHERE docid NOT IN (SELECT docid FROM qrels) UNION ALL SELECT source, qid, NULL, 'depth' FROM runs GROUP BY source, qid HAVING count(*) > 150)"))
def tagged_run_violations(spark, d):
    """Decimal-scored runs bound to their tags, an inventory of the judged documents and a depth of 150, with a wrong tag and a bad rank in places."""
    tag = F.when((F.col("source") == "orders") & (F.col("rank") == 3), "other").otherwise(F.col("source"))
    rank = F.when((F.col("source") == "returned") & (F.col("rank") == 0), "-1").otherwise(F.col("rank").cast("string"))
    lines = W.runs(spark, d).select("source", F.concat_ws(" ", F.regexp_replace("qid", " ", "_"), F.lit("Q0"), "docid", rank, F.col("score").cast("bigint").cast("string"), tag).alias("value"))
    return trec.tagged_violations(lines, W.qrels(spark, d), None, 150)


# labels in two states: the later one also judges what the first leaves out at random


def _late(spark, d):
    """The judgments and, of the other suppliers, every second one."""
    early = W.qrels(spark, d)
    extra = W.table(spark, d, "supplier").where("s_suppkey % 8 = 0")
    types = early.select("qid").distinct()
    grade = F.pmod(F.floor("s_acctbal") + F.length("qid"), F.lit(3)).cast("int")
    return early.unionByName(types.join(extra, F.lit(True)).select("qid", F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("docid"), grade.alias("grade")))


_LATE = "late AS (SELECT * FROM qrels UNION ALL SELECT qid, lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), CAST((((CAST(floor(s_acctbal) AS BIGINT) + length(qid)) % 3) + 3) % 3 AS INT) FROM (SELECT DISTINCT p_type AS qid FROM part) CROSS JOIN supplier WHERE s_suppkey % 8 = 0)"


@query(with_runs("SELECT l.qid, l.docid, CAST(NULL AS INT) AS early_grade, l.grade AS late_grade, 'added' AS kind FROM late l WHERE NOT EXISTS (SELECT 1 FROM qrels q WHERE q.qid = l.qid AND q.docid = l.docid)", _LATE))
def label_changes(spark, d):
    return bounds.label_changes(W.qrels(spark, d), _late(spark, d))


def _phase(name: str) -> str:
    return Q._interval_sql(Q._HEADS, BINARY, 1).replace("LEFT JOIN qrels q", f"LEFT JOIN {name} q")


def _decision(low: str, high: str) -> str:
    return f"CASE WHEN {low} > 0 THEN 'all_completions_positive' WHEN {high} <= 0 THEN 'positive_excluded' ELSE 'sign_unresolved' END"


@query(with_runs(f"SELECT e.qid, e.lower AS early_lower, e.upper AS early_upper, l.lower AS late_lower, l.upper AS late_upper, l.lower - e.lower + e.upper - l.upper AS width_reduction, e.unknown - l.unknown AS revealed, l.lower - e.lower AS raised, e.upper - l.upper AS lowered, l.lower >= e.lower AND l.upper <= e.upper AS nested, {_decision('e.lower', 'e.upper')} AS early_decision, {_decision('l.lower', 'l.upper')} AS late_decision FROM ({_phase('qrels')}) e JOIN ({_phase('late')}) l ON l.qid = e.qid", _LATE))
def compare_phases(spark, d):
    runs = W.runs(spark, d)
    coef = bounds.head_coefficients(fusion.rrf(runs).where("rank0 < 10"), Q._list(runs, "returned").where("rank0 < 10"))
    return bounds.compare_phases(coef, W.qrels(spark, d), _late(spark, d))


_GROUP = "CASE WHEN length(qid) % 2 = 1 THEN 'odd' ELSE 'even' END"


@query(with_runs(f"SELECT *, {Q._STATUS} AS status FROM (SELECT {_GROUP} AS \"group\", count(*) AS queries, CAST(sum(lower) AS BIGINT) AS lower, CAST(sum(upper) AS BIGINT) AS upper, CAST(sum(upper - lower) AS BIGINT) AS width, {', '.join(f'''CAST(count(*) FILTER ({Q._STATUS} = '{x}') AS BIGINT) AS {x}''' for x in ('a_better', 'b_better', 'tie', 'unresolved'))}, CAST(count(*) FILTER (lower = upper) AS BIGINT) AS zero_width, CAST(count(*) FILTER (unknown > 0) AS BIGINT) AS with_unknown FROM ({Q._interval_sql(Q._SIDES, 'grade', 3)}) GROUP BY 1)"))
def annual_summary(spark, d):
    """Bounds on RBP summed up for each collection: part types whose names are of odd or even length."""
    return bounds.annual_summary(Q.rbp_bounds(spark, d).withColumn("group", W.collection()))


@query(with_runs(f"SELECT budget, queries, count(*) AS nonempty, CAST(sum(realized) AS BIGINT) AS realized, {', '.join(f'round(sum({c}) / queries, 6) AS {n}' for c, n in (('width', 'width'), ('by_influence', 'by_influence'), ('by_head', 'by_head'), ('by_chance::DOUBLE / pool', 'by_chance')))}, CAST(count(*) FILTER (shared = realized) + queries - count(*) AS BIGINT) AS alike, CAST(sum(shared) AS BIGINT) AS shared FROM ({Q._PLAN}) CROSS JOIN (SELECT count(DISTINCT qid) AS queries FROM runs) GROUP BY budget, queries"))
def acquisition_summary(spark, d):
    return bounds.acquisition_summary(Q.acquisition_plan(spark, d), W.runs(spark, d))


_EXES = f"SELECT qid FROM ({Q._EX})"


@query(with_runs(f"SELECT scope, count(*) AS queries, CAST(sum(known) AS BIGINT) AS known, CAST(sum(lower) AS BIGINT) AS lower, CAST(sum(upper) AS BIGINT) AS upper, CAST(sum(unknown) AS BIGINT) AS unknown, {Q._SIGN.replace('lower', 'sum(lower)').replace('upper', 'sum(upper)')} FROM (SELECT 'all' AS scope, * FROM iv UNION ALL SELECT 'triggered', * FROM iv WHERE qid IN ({_EXES})) GROUP BY scope", *Q._EX_CTES, f"iv AS ({Q._interval_sql(Q._HEADS, BINARY, 1)})"))
def triggered_average(spark, d):
    """P@10 bounds summed over all queries, and over those in which a minority exchange takes place."""
    runs = W.runs(spark, d)
    m = bounds.minority_exchange(Q._list(runs, "revenue").where("rank0 < 20"), Q._list(runs, "returned"), fusion.rrf(runs.where("source in ('revenue', 'returned')")))
    return bounds.average(Q.p10_bounds(spark, d).drop("sign", "decision"), m)


@query(with_runs(f"SELECT qid, 'M' AS policy, admitted, displaced FROM ({Q._EX}) UNION ALL SELECT x.qid, 'J', (SELECT min_by(docid, rank) FROM runs r WHERE r.qid = x.qid AND source = 'returned' AND rank < 10 AND NOT EXISTS (SELECT 1 FROM hy h WHERE h.qid = r.qid AND h.docid = r.docid AND rank0 < 10)), displaced FROM ({Q._EX}) x", *Q._EX_CTES))
def generic_exchange(spark, d):
    runs = W.runs(spark, d)
    return bounds.generic_exchange(Q._list(runs, "revenue").where("rank0 < 20"), Q._list(runs, "returned"), fusion.rrf(runs.where("source in ('revenue', 'returned')")))


_CONTROLS = Q.REPLICATES
_CHEADS = f"ch AS (SELECT rep, qid, docid FROM ({exact.exact_sql('dr', 'rep, qid')}) WHERE rank0 < 10)"
_CC = f"SELECT contrast, qid, docid, CAST(sum(coef) AS BIGINT) AS coef FROM (SELECT 'F-C' AS contrast, qid, docid, {_CONTROLS} AS coef FROM (SELECT * FROM ({Q.rank_sql(Q.RRF)}) WHERE rank0 < 10) UNION ALL SELECT 'S-C', qid, docid, {_CONTROLS} FROM runs WHERE source = 'returned' AND rank < 10 UNION ALL SELECT n, qid, docid, -count(*) FROM ch CROSS JOIN (VALUES ('F-C'), ('S-C')) AS v(n) GROUP BY n, qid, docid) GROUP BY ALL HAVING sum(coef) <> 0"


@query(with_runs(Q._interval_sql(_CC, BINARY, 1, "contrast"), Q.CLASSES_SQL, f"dr AS ({Q.DRAWN_SQL})", exact.units_sql(), _CHEADS))
def control_mean_bounds(spark, d):
    """P@10 of the fused and of one list's heads less the mean of permuted controls, over their number times ten, all queries together."""
    runs, qrels = W.runs(spark, d), W.qrels(spark, d)
    drawn = fusion.permutation_control(runs, qrels, _CONTROLS)
    heads = exact.exact_rrf(drawn, by=("rep", "qid"), head=10)
    named = fusion.rrf(runs).where("rank0 < 10").select(F.lit("F").alias("name"), "qid", "docid").unionByName(Q._list(runs, "returned").where("rank0 < 10").select(F.lit("S").alias("name"), "qid", "docid"))
    return bounds.interval(bounds.control_coefficients(named, heads, _CONTROLS), qrels, ["contrast"], (F.col("grade") > 0).cast("bigint"))


_COMMON = f"""SELECT queries, infeasible, reason = 'feasible' AS feasible, reason, round(lower_num::DOUBLE / lower_den, 9) AS lower, lower_strict, lower_qid, round(upper_num::DOUBLE / upper_den, 9) AS upper, upper_strict, upper_qid FROM (SELECT *, CASE WHEN infeasible > 0 THEN 'query_infeasible' WHEN upper_num IS NULL OR lower_num::HUGEINT * upper_den < upper_num::HUGEINT * lower_den OR lower_num::HUGEINT * upper_den = upper_num::HUGEINT * lower_den AND NOT lower_strict AND NOT upper_strict THEN 'feasible' ELSE 'empty_common' END AS reason FROM
(SELECT count(*) AS queries, CAST(count(*) FILTER (NOT feasible) AS BIGINT) AS infeasible FROM si)
CROSS JOIN (SELECT qid AS lower_qid, lower_num, lower_den, lower_strict FROM si ORDER BY lower_num::HUGEINT * 1000000000000000000 // lower_den DESC, lower_strict DESC, qid LIMIT 1)
LEFT JOIN (SELECT qid AS upper_qid, upper_num, upper_den, upper_strict FROM si WHERE upper_den IS NOT NULL ORDER BY upper_num::HUGEINT * 1000000000000000000 // upper_den, upper_strict DESC, qid LIMIT 1) ON true)"""


@query(with_runs(_COMMON, *Q._SCALAR_CTES, f"si AS ({Q._SCALAR})"))
def common_scalar_interval(spark, d):
    return bounds.common_interval(Q.scalar_interval(spark, d))


SHORT = 40
SHORT_SQL = W.RUNS_SQL.replace(f"WHERE rank < {W.DEPTH})", f"WHERE rank < {SHORT})")


def with_short(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([SHORT_SQL, *ctes])} {body}"


_SHARES = f'SELECT qid, "group", sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) / count(*) AS l, sum(CASE WHEN grade >= 2 OR grade IS NULL THEN 1 ELSE 0 END) / count(*) AS u FROM (SELECT s.qid, s."group", grade FROM ({Q._SPEC}) s LEFT JOIN qrels q ON q.qid = s.qid AND q.docid = s.docid) GROUP BY ALL'
_CONTRAST = f"""SELECT a.qid, round(a.l - b.u, 9) AS lower, round(a.u - b.l, 9) AS upper, round(a.u - b.l - (a.l - b.u), 9) AS width FROM (SELECT * FROM ({_SHARES}) WHERE "group" = 'tail_supported') a JOIN (SELECT * FROM ({_SHARES}) WHERE "group" = 'isolated') b ON a.qid = b.qid"""


@query(with_runs(_CONTRAST))
def specialist_contrast(spark, d):
    return bounds.share_contrast(sets.specialists(W.runs(spark, d)), W.qrels(spark, d))


# overlaps, owners and observations


@query(with_runs(f"SELECT a, b, count(*) AS queries, round(avg(jaccard), 8) AS jaccard FROM ({Q._JACCARD}) GROUP BY a, b"))
def mean_jaccard(spark, d):
    return sets.mean_jaccard(W.runs(spark, d))


@query(with_runs("SELECT * FROM runs WHERE qid IN (SELECT qid FROM runs GROUP BY qid HAVING count(DISTINCT source) >= 2)"))
def two_lists(spark, d):
    return sets.at_least(W.runs(spark, d))


@query(with_runs(f"""SELECT stratum, count(*) AS pairs, count(ar - br) AS judged_pairs, round(avg(aj - bj), 9) AS judged, round(avg(ar - br), 9) AS relevant, round(avg(ag - bg), 9) AS gain FROM
(SELECT qid, stratum, aj, ar, ag FROM g0 WHERE "group" = 'tail_supported') a JOIN (SELECT qid, stratum, aj AS bj, ar AS br, ag AS bg FROM g0 WHERE "group" = 'isolated') b USING (qid, stratum) GROUP BY stratum""", f'g0 AS (SELECT s.qid, s.stratum, s."group", avg(CASE WHEN grade IS NULL THEN 0 ELSE 1 END) AS aj, avg(CASE WHEN grade IS NULL THEN NULL WHEN grade >= 2 THEN 1 ELSE 0 END) AS ar, avg(power(2.0, coalesce(grade, 0)) - 1) AS ag FROM ({Q._SPEC}) s LEFT JOIN qrels q ON q.qid = s.qid AND q.docid = s.docid GROUP BY ALL)'))
def group_contrast(spark, d):
    return sets.group_contrast(sets.specialists(W.runs(spark, d)), W.qrels(spark, d))


@query(with_runs(f'SELECT owner, "group", count(DISTINCT s.qid) AS queries, count(*) AS n, count(grade) AS judged, count(DISTINCT CASE WHEN grade IS NOT NULL THEN s.qid END) AS visible_queries FROM ({Q._SPEC}) s LEFT JOIN qrels q ON q.qid = s.qid AND q.docid = s.docid GROUP BY ALL'))
def owner_summary(spark, d):
    return sets.owner_summary(sets.specialists(W.runs(spark, d)), W.qrels(spark, d))


@query(with_runs("SELECT qid, docid, " + ", ".join(f"max(CASE WHEN source = '{s}' THEN rank + 1 END) AS rank_{s}" for s in W.SOURCES) + " FROM runs GROUP BY qid, docid"))
def document_observation(spark, d):
    return sets.observation(W.runs(spark, d), list(W.SOURCES))


_DEPTHS = {"revenue": 100, "quantity": 200, "orders": 90, "copy": 5}
_WANT = f"want(source, n) AS (VALUES {', '.join(map(str, _DEPTHS.items()))})"


@query(with_runs("SELECT coalesce(h.source, w.source) AS source, coalesce(h.qid, w.qid) AS qid, CASE WHEN w.n IS NULL THEN 'unexpected source' WHEN h.n IS NULL THEN 'missing' ELSE 'depth' END AS problem FROM (SELECT source, qid, count(*) AS n FROM runs GROUP BY ALL) h FULL JOIN (SELECT want.*, qid FROM want CROSS JOIN (SELECT DISTINCT qid FROM runs)) w ON w.source = h.source AND w.qid = h.qid WHERE h.n IS DISTINCT FROM w.n", _WANT))
def retained_depth_violations(spark, d):
    """Lists that should have certain depths: one does or doesn't as the tables grow, others never do, one is missing and one isn't expected."""
    runs = W.runs(spark, d)
    return sets.retained_depths(runs, _DEPTHS, runs.select("qid").distinct().count())


# fractions, ids


@query(with_runs("SELECT qid, docid, variant, category, num, den FROM (SELECT qid, docid, variant, CASE WHEN a IS NOT NULL AND v IS NOT NULL THEN 'shared' WHEN v IS NOT NULL THEN 'arrival' WHEN a IS NOT NULL THEN 'departure' ELSE 'absent' END AS category, CAST(CASE WHEN a IS NOT NULL AND v IS NOT NULL THEN a - v WHEN v IS NOT NULL THEN 1 WHEN a IS NOT NULL THEN -1 ELSE 0 END AS BIGINT) AS num, CAST(CASE WHEN a IS NOT NULL AND v IS NOT NULL THEN 3 * (60 + a) * (60 + v) WHEN v IS NOT NULL THEN 3 * (60 + v) WHEN a IS NOT NULL THEN 3 * (60 + a) ELSE 1 END AS BIGINT) AS den FROM (SELECT qid, docid, ra AS a, unnest(['quantity', 'orders']) AS variant, unnest([rq, ro]) AS v FROM (SELECT qid, docid, " + ", ".join(f"max(CASE WHEN source = '{s}' THEN rank + 1 END) AS r{s[0] if s != 'returned' else 'x'}" for s in W.SOURCES).replace("AS rr", "AS ra") + " FROM runs GROUP BY qid, docid)))"))
def family_decomposition(spark, d):
    return fusion.decomposition(W.runs(spark, d), "revenue", ["quantity", "orders"], "returned")


@query(with_runs("SELECT qid, CAST(l // g AS VARCHAR) || '/' || CAST(w // g AS VARCHAR) AS lower, CAST(u // h AS VARCHAR) || '/' || CAST(w // h AS VARCHAR) AS upper FROM (SELECT *, greatest(gcd(abs(l), w), 1) AS g, greatest(gcd(abs(u), w), 1) AS h FROM (SELECT qid, lower AS l, upper AS u, CAST(29296875 AS BIGINT) AS w FROM (" + Q._interval_sql(Q._SIDES, "grade", 3) + ")))"))
def rational_bounds(spark, d):
    """RBP bounds as fractions in lowest terms."""
    den = F.lit(bounds.RBP_SCALE).cast("bigint")
    return Q.rbp_bounds(spark, d).select("qid", text_functions.rational(F.col("lower"), den).alias("lower"), text_functions.rational(F.col("upper"), den).alias("upper"))


@query("""SELECT r_regionkey, json, sha256(json) AS id, sha256('7:' || r_name) AS seed FROM (SELECT *, '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS json FROM region)""")
def canonical_ids(spark, d):
    names = ["r_regionkey", "r_name"]
    return W.table(spark, d, "region").select("r_regionkey", text_functions.canonical_json(names).alias("json"), text_functions.content_id(names).alias("id"), text_functions.digest_seed(F.lit("7"), F.col("r_name")).alias("seed"))


# joint errors

_ERRORS = "pr AS (SELECT r.qid, length(r.qid) % 2 AS stratum, g >= 2 AS truth, (g >= 2) <> (r.rank < 5) AS g_error, (g >= 2) <> coalesce(s.rank < 5, false) AS s_error FROM (SELECT runs.*, grade AS g FROM runs JOIN qrels ON qrels.qid = runs.qid AND qrels.docid = runs.docid WHERE source = 'revenue' AND rank < 20) r LEFT JOIN runs s ON s.source = 'returned' AND s.qid = r.qid AND s.docid = r.docid)"
_CELLS = ", ".join(f"CAST(count(*) FILTER (g_error = {bool(g)} AND s_error = {bool(s)}) AS BIGINT) AS n{g}{s}" for g in (0, 1) for s in (0, 1))


@query(with_runs(f"""SELECT "group", value, n, n00, n01, n10, n11, round((n10 + n11) / n, 9) AS g_error, round((n01 + n11) / n, 9) AS s_error, round((n10 + n01) / n, 9) AS disagreement, round(n10 / n, 9) AS correction, round(n10 / nullif(n10 + n11, 0), 9) AS conditional_correction, round(n01 / n, 9) AS harm, round(n01 / nullif(n - n10 - n11, 0), 9) AS conditional_harm, round((n01 - n10) / n, 9) AS s_minus_g, n11 * n - (n10 + n11) * (n01 + n11) AS excess_num, n * n AS excess_den
FROM (SELECT 'all' AS "group", '' AS value, count(*) AS n, {_CELLS} FROM pr UNION ALL SELECT 'truth', CAST(truth AS VARCHAR), count(*), {_CELLS} FROM pr GROUP BY truth UNION ALL SELECT 'stratum', CAST(stratum AS VARCHAR), count(*), {_CELLS} FROM pr GROUP BY stratum) WHERE n > 0""", _ERRORS))
def joint_error_table(spark, d):
    """How two lists err together about relevance, where a document among a list's first five counts as its yes."""
    from rankloom.operators import statistics

    runs = W.runs(spark, d)
    g = runs.where("source = 'revenue' and rank < 20").join(W.qrels(spark, d), ["qid", "docid"]).select("qid", "docid", (F.col("rank") < 5).alias("g"), (F.col("grade") >= 2).alias("truth"))
    s = runs.where("source = 'returned'").select("qid", "docid", (F.col("rank") < 5).alias("s"))
    rows = g.join(s, ["qid", "docid"], "left").withColumn("s", F.coalesce("s", F.lit(False)))
    return statistics.joint_errors(rows.select("truth", (F.col("truth") != F.col("g")).alias("g_error"), (F.col("truth") != F.col("s")).alias("s_error"), (F.length("qid") % 2).alias("stratum")), ["stratum"])


# fusions that are told their share, and gates

_ALPHAS = [i / 10 for i in range(11)]
_MOD = f"SELECT a.alpha, v.qid, v.docid, v.score * (1 + a.alpha * CASE WHEN v.rank0 > f.rank0 THEN ln(1 + v.rank0 - f.rank0) * 0.1 ELSE 0.0 - ln(1 + f.rank0 - v.rank0) * 0.05 END) AS score FROM ({Q.rank_sql(Q.RRF)}) v JOIN ({consensus.fuse_sql(W.SOURCES, 'v5')}) f ON f.qid = v.qid AND f.docid = v.docid CROSS JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _ALPHAS)}) AS a(alpha)"


@query(with_runs(Q.rank_sql(_MOD, ("alpha", "qid"))))
def modulated_score_mix(spark, d):
    """Vanilla scores moved towards the places of v5, for each of eleven shares."""
    runs = W.runs(spark, d)
    return fusion.modulated(fusion.rrf(runs), consensus.fuse(runs, W.SOURCES, "v5"), _ALPHAS)


_SHARP_RRF = Q.SQL["sharpness_rrf"].split(W.RUNS_SQL, 1)[1]


@query(with_runs(Q.rank_sql(f"SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.docid, b.docid) AS docid, 0.5 * coalesce(1.0 / (a.rank0 + 1), 0) + 0.5 * coalesce(1.0 / (b.rank0 + 1), 0) AS score FROM ({_SHARP_RRF}) a FULL JOIN ({consensus.fuse_sql(W.SOURCES, 'v5')}) b ON a.qid = b.qid AND a.docid = b.docid")))
def sharpness_v5_hybrid(spark, d):
    runs = W.runs(spark, d)
    return fusion.positional_mix(fusion.sharpness_rrf(runs), consensus.fuse(runs, W.SOURCES, "v5"))


for _how, _absent in {"tail": "coalesce(max(CASE WHEN bin = 9 THEN log_odds END), max(marginal))", "zero": "0.0"}.items():
    query(with_runs(Q.rank_sql(f"SELECT qid, docid, sum(log_odds - m) + (SELECT sum(m) FROM mm) AS score FROM runs r JOIN o ON o.source = r.source AND o.bin = r.rank // 5 JOIN mm ON mm.source = r.source WHERE rank < 50 GROUP BY qid, docid"), f"o AS ({Q._ODDS})", f"mm AS (SELECT source, {_absent} AS m FROM o GROUP BY source)"), f"empirical_fusion_{_how}")(lambda spark, d, how=_how: fusion.empirical_fusion(W.runs(spark, d), fusion.empirical_log_odds(W.runs(spark, d), W.qrels(spark, d)), missing=how))


@query(with_runs("SELECT source, CAST(k.rank AS INT) AS rank, log_odds AS learned, round(1.0 / (60 + k.rank), 10) AS reciprocal FROM o JOIN range(50) k(rank) ON k.rank // 5 = o.bin", f"o AS ({Q._ODDS})"))
def decay_curves(spark, d):
    return fusion.decay_curve(fusion.empirical_log_odds(W.runs(spark, d), W.qrels(spark, d)))


_SIGNALS = f"""sg AS (SELECT r.qid, r.docid, r.c / 4 AS cov, CASE WHEN r.c >= 2 THEN sd / (mu + 60) ELSE 0.0 END AS disp, greatest(0.0, (coalesce(v.rank0, 200) - coalesce(s.rank, 200)) / 200) AS lift, (0.0 - (spl - sp * ln(sp + 1e-12)) / (sp + 1e-12)) / (ln(4) + 1e-12) AS ent
FROM (SELECT qid, docid, count(*) AS c, avg(rank) AS mu, stddev_pop(rank) AS sd, sum(1.0 / (61.0 + rank)) AS sp, sum(ln(1.0 / (61.0 + rank)) / (61.0 + rank)) AS spl FROM runs GROUP BY qid, docid) r LEFT JOIN ({Q.rank_sql(Q.RRF)}) v ON v.qid = r.qid AND v.docid = r.docid LEFT JOIN runs s ON s.source = 'returned' AND s.qid = r.qid AND s.docid = r.docid)"""


def _gate_sql(n: int) -> str:
    a, b, c, e, bias = fusion.GATES[n]
    return f"round(0.05 + 0.55 * power(tq, 1.5) / (1 + exp(-greatest(-20.0, least(20.0, {a} * (1 - cov) + {b} * disp + {c} * lift + {e} * (1 - ent) + {bias})))), 9)"


@query(with_runs(f"SELECT g.qid, g.docid, {_gate_sql(3)} AS gate3, {_gate_sql(4)} AS gate4 FROM sg g JOIN ({Q._TQ}) t ON t.qid = g.qid", _SIGNALS))
def document_gates(spark, d):
    """How far each document listens to the list 'returned'."""
    runs = W.runs(spark, d)
    signals = fusion.gate_signals(runs, fusion.rrf(runs), Q._list(runs, "returned"), len(W.SOURCES))
    return fusion.gates(signals, consensus.regime(runs, W.SOURCES))


_ORACLES = ("vanilla", "v3", "v40", "v5", "v21", "ref_scoremix")


@query(with_runs("SELECT count(*) AS n, round(avg(greatest(vanilla, v5)), 9) AS oracle2, round(avg(greatest(vanilla, v5, ref_scoremix)), 9) AS oracle3, round(avg(greatest(vanilla, v3, v5, ref_scoremix)), 9) AS oracle4, round(avg(greatest(vanilla, v3, v40, v5, ref_scoremix)), 9) AS oracle5, round(avg(greatest(vanilla, v21, v3, v40, v5, ref_scoremix)), 9) AS oracle6 FROM " + " JOIN ".join(f"(SELECT qid, ndcg10 AS {v} FROM ({Q.metrics.evaluate_sql(Q.rank_sql(Q.RRF) if v == 'vanilla' else consensus.fuse_sql(W.SOURCES, v))})) AS m_{v}" + ("" if not i else " USING (qid)") for i, v in enumerate(_ORACLES))))
def oracle_classes(spark, d):
    """The best of two to six fusions for each query, on average."""
    runs, qrels = W.runs(spark, d), W.qrels(spark, d)
    rows = None
    for v in _ORACLES:
        one = Q.metrics.evaluate(fusion.rrf(runs) if v == "vanilla" else consensus.fuse(runs, W.SOURCES, v), qrels).select("qid", F.col("ndcg10").alias(v))
        rows = one if rows is None else rows.join(one, "qid")
    sets_ = {"oracle2": ("vanilla", "v5"), "oracle3": ("vanilla", "v5", "ref_scoremix"), "oracle4": ("vanilla", "v3", "v5", "ref_scoremix"), "oracle5": ("vanilla", "v3", "v40", "v5", "ref_scoremix"), "oracle6": _ORACLES}
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.greatest(*cs)), 9).alias(k) for k, cs in sets_.items()])

