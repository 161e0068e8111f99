"""Exact reciprocal sums: numbers over one denominator as limbs of fifteen digits, so sums of longs carry no error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 10**15


def limbs(k: int = 60, depth: int = 200) -> int:
    """How many limbs the common denominator lcm(k+1..k+depth) needs."""
    return -(-len(str(math.lcm(*range(k + 1, k + depth + 1)))) // 15)


def unit_rows(k: int = 60, depth: int = 200) -> list[tuple]:
    """rank (from 0) and the limbs, lowest first, of lcm(k+1..k+depth) / (k + rank + 1)."""
    whole, n = math.lcm(*range(k + 1, k + depth + 1)), limbs(k, depth)
    return [(rank, *[whole // (k + rank + 1) // BASE**i % BASE for i in range(n)]) for rank in range(depth)]


def units(spark: SparkSession, k: int = 60, depth: int = 200) -> DataFrame:
    return spark.createDataFrame(unit_rows(k, depth), "rank int, " + ", ".join(f"l{i} bigint" for i in range(limbs(k, depth))))


def exact_sums(runs: DataFrame, by: list[str], k: int = 60, depth: int = 200, times: Column | None = None) -> DataFrame:
    """by and the limbs of the sum of 1 / (k + rank + 1), with carries, lowest first. times: whole weights. A row deeper than the table of units raises."""
    n, unit = limbs(k, depth), units(runs.sparkSession, k, depth)
    times = F.lit(1) if times is None else times
    rows = runs.withColumn("rank", F.when(F.col("rank") < depth, F.col("rank")).otherwise(F.raise_error(F.lit(f"a rank beyond {depth}")).cast("int"))).join(F.broadcast(unit), "rank")
    return carried(rows.groupBy(*by).agg(*[F.sum(F.col(f"l{i}") * times).alias(f"l{i}") for i in range(n)]), n)


def carried(rows: DataFrame, n: int) -> DataFrame:
    """rows with limbs l0.. below BASE but for the highest."""
    for i in range(n - 1):
        rows = rows.withColumn(f"l{i + 1}", F.col(f"l{i + 1}") + F.expr(f"l{i} div {BASE}")).withColumn(f"l{i}", F.col(f"l{i}") % BASE)
    return rows


#: Bits of a limb of a double, and how many limbs after the point: what is below 2 ** -(BITS * PARTS) has no place.
BITS, PARTS = 40, 3


def double_limbs(x: Column) -> list[Column]:
    """A double, less than 2**22 in size, as whole numbers of its sign: its whole part and PARTS limbs of BITS bits after the point, exactly, as scaling by a power of two and taking a whole part off are. A double of 53 bits is whole from 2**-67 on; what a smaller one has beyond the last limb raises."""
    sign, rest, out = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint"), F.abs(x.cast("double")), []
    for _ in range(PARTS + 1):
        whole = F.floor(rest)
        out.append(sign * whole)
        rest = (rest - whole.cast("double")) * float(1 << BITS)
    out[-1] = F.when(rest == 0, out[-1]).otherwise(F.raise_error(F.lit("a double with bits beyond the last limb")).cast("bigint"))
    return out


def _summed(terms: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, the carried limbs d0.. of the sum of a double without any error, and score, the sum as a double. Limbs are summed as longs, in any order and in every map task first, and carried at the end."""
    names = [f"d{i}" for i in range(PARTS + 1)]
    sums = terms.select(*keys, *[c.alias(n) for c, n in zip(double_limbs(F.col(x)), names)]).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    for i in range(PARTS, 0, -1):
        sums = sums.withColumn(f"d{i - 1}", F.col(f"d{i - 1}") + F.shiftright(f"d{i}", BITS)).withColumn(f"d{i}", F.col(f"d{i}").bitwiseAND(F.lit((1 << BITS) - 1)))
    score = F.lit(0.0)
    for n in reversed(names):
        score = score / float(1 << BITS) + F.col(n)
    return sums.withColumn("score", score)


def exact_scores(terms: DataFrame, by: list[str] | None = None, x: str = "x") -> DataFrame:
    """terms(by, docid, x) to by, docid, score: sums of doubles that don't depend on the order of rows, so equal documents have equal scores."""
    keys = [*(by or ["qid"]), "docid"]
    return _summed(terms, keys, x).select(*keys, "score")


def exact_ranking(terms: DataFrame, by: list[str] | None = None, depth: int | None = None, x: str = "x") -> DataFrame:
    """terms(by, docid, x) to by, docid, rank0, score: documents by the sum of their doubles without any error, then docid; so near-ties are told apart and true ties found, as fractions would, without rounding. score is the nearest double of the sum."""
    from rankloom.operators.ranking import rank_within

    by = by or ["qid"]
    order = [*[F.desc(f"d{i}") for i in range(PARTS + 1)], F.asc("docid")]
    return rank_within(_summed(terms, [*by, "docid"], x), by, order, depth, "rank0").select(*by, "docid", "rank0", "score")


def exact_order(k: int = 60, depth: int = 200) -> list[Column]:
    """Greatest sum first, then docid."""
    return [*[F.desc(f"l{i}") for i in reversed(range(limbs(k, depth)))], F.asc("docid")]


def exact_rrf(runs: DataFrame, k: int = 60, depth: int = 200, times: dict[str, int] | None = None, by: tuple[str, ...] = ("qid",), head: int | None = None) -> DataFrame:
    """RRF whose order no rounding touches: by, docid, rank0. times: whole weights by source. The table of units has depth rows, a parameter. Only the first head documents, if given."""
    from rankloom.operators.ranking import rank_within

    n = None if times is None else F.coalesce(*[F.when(F.col("source") == s, F.lit(x)) for s, x in times.items()])
    rows = exact_sums(runs, [*by, "docid"], k, depth, n)
    return rank_within(rows, list(by), exact_order(k, depth), head, "rank0").select(*by, "docid", "rank0")


def exact_sql(rows: str, by: str = "qid", k: int = 60, depth: int = 200, times: str = "1") -> str:
    """SQL of exact_rrf over rows(by, docid, rank, ...)."""
    n = limbs(k, depth)
    sql = f"SELECT {by}, docid, {', '.join(f'CAST(sum(l{i} * {times}) AS HUGEINT) AS l{i}' for i in range(n))} FROM {rows} r JOIN units u ON u.rank = r.rank GROUP BY {by}, docid"
    for i in range(n - 1):
        sql = f"SELECT * REPLACE (l{i + 1} + l{i} // {BASE} AS l{i + 1}, l{i} % {BASE} AS l{i}) FROM ({sql})"
    order = ", ".join(f"l{i} DESC" for i in reversed(range(n)))
    return f"SELECT {by}, docid, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}, docid) - 1 AS INT) AS rank0 FROM ({sql})"


def units_sql(k: int = 60, depth: int = 200) -> str:
    """A common table expression of the units."""
    return f"units(rank, {', '.join(f'l{i}' for i in range(limbs(k, depth)))}) AS (VALUES {', '.join(map(str, unit_rows(k, depth)))})"
