"""Source divergence audit: how far the vocabularies of a language's sources lie apart, and which terms set a source apart from its language.

Terms are runs of letters: ASCII letters, of which A-Z count as a-z, and all characters beyond ASCII. A language keeps the V terms that at least LEAST of its documents have. A group (a source of a language, or the language as a whole) gives a kept term p = 1 + floor(SCALE (count + 1) / (N + V)), N its occurrences of kept terms; the divergence of p from q at a term is floor((p - q)^2 / q). All of this is integers.

Counting. A task cuts the texts of many documents into terms at once, numbers the terms, sorts (group, term, document) as one number each and reads both counts off the runs; what it has goes out whenever its buffers are full, so a very common term is one row of each source and buffer. One shuffle by language and term serves the aggregation and the window after it, in which a term has at most a row for each source.

Sparse baseline-corrected pairs. Most terms of a language are missing from most sources, and all terms that two sources lack contribute alike. So the sum over all V terms is V times the contribution of a term that both lack (the baseline), corrected for the terms that one has as if the other lacked them, and corrected again for those that both have. The first correction needs only how often each p occurs in a group, the second a join of the sources that share a term. No absent term is ever a row.

Radix-select ranking. The k greatest of each group are found without sorting a group: a distributed histogram over the values' lengths in bits and the bits that follow finds the bin that holds the k-th, the next one looks into this bin only, until the bin is used up as a whole, has few rows or is one value; ties of that value are then refined by the same histograms over two bytes of the item at a time, after the bytes that all ties share. Only the rows that remain, k and at most FEW others of each group, are ordered. A round's state is one row for each group.

Defined results: null text, language and source count as empty. Groups whose documents have no kept term take part, with N = 0; a language without kept terms has pairs of value 0 and no terms. Every row is a document, repeated ones too. An empty table gives no rows. Only the three columns named are read, whatever others there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, small_batches, table

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: The greatest long.
LONG = (1 << 63) - 1
#: A task sends its counts at so many terms (repeats included), bytes of them, or documents.
ENTRIES, BYTES, DOCS = 3_000_000, 1 << 25, 1 << 18
#: Counts that a task sends in one Arrow batch.
ROWS = 1 << 18
#: Text that is split at once, in bytes; longer texts are counted one by one, in slices.
SLICE = 1 << 22
#: Groups whose state is broadcast at most, counted before; more are joined by shuffle.
GROUPS = 20_000
#: Bits of a value (six of them for its length) and bytes of an item that one histogram reads.
BITS, WIDTH = 16, 2
#: A bin of so many rows is ordered as it is.
FEW = 1024

_LETTER = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_TERM = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FOLD = _LETTER.translate(_TERM)


def terms(data: bytes) -> Counter:
    """How often each term stands in UTF-8 text; the text is read in slices that end between terms."""
    found: Counter = Counter()
    left = b""
    for at in range(0, len(data), SLICE):
        piece = left + data[at : at + SLICE].translate(FOLD)
        last = at + SLICE >= len(data)
        cut = len(piece) if last else piece.rfind(b" ") + 1
        found.update(piece[:cut].split())
        left = piece[cut:]
    return found


def cut(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that end at the given bytes of data, cut into terms: the terms' letters without what stands between them, where in these each term begins, and how many terms each text has."""
    folded = np.frombuffer(data.translate(FOLD), np.uint8)
    inside = folded != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = ends[ends < len(folded)]
    first[at] = inside[at]  # a term ends where its text ends
    return folded[inside], np.flatnonzero(first[inside]).astype(np.int32), np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)


def tally(letters: np.ndarray, begins: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of each term of a group. docs gives the terms' documents, in order, groups the documents' groups."""
    offsets = pa.py_buffer(np.append(begins, len(letters)).astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, offsets, pa.py_buffer(letters)]).dictionary_encode()
    bits, kinds = len(groups).bit_length(), max(len(coded.dictionary), 1)
    key = groups[docs]
    key *= kinds
    key += coded.indices.to_numpy()
    key <<= bits  # all of a buffer: documents, kinds and groups together fit 63 bits
    key |= docs
    key.sort()
    other = np.diff(key, prepend=-1) != 0
    key >>= bits
    at = np.flatnonzero(np.diff(key, prepend=-1))
    group, term = np.divmod(key[at], kinds)
    df = np.add.reduceat(other, at, dtype=np.int64) if len(at) else at
    return group, pa.DictionaryArray.from_arrays(pa.array(term, pa.int32()), coded.dictionary), np.diff(at, append=len(key)), df


def _counted(rows: DataFrame) -> DataFrame:
    """rows(lang, source, text) to lang, source, term, n (occurrences), df (documents), counted in parts; the empty term stands for the group itself."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple, int] = {}
        parts: list[tuple] = []
        groups: list[int] = []

        def batch(group, term, n, df):
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], ["lang", "source", "term", "n", "df"])

        def flush():
            letters, begins, counts = zip(*parts)
            shift = np.cumsum([0] + [len(x) for x in letters[:-1]], dtype=np.int32)
            docs = np.repeat(np.arange(len(groups), dtype=np.int32), np.concatenate(counts))
            group, term, n, df = tally(np.concatenate(letters), np.concatenate([b + s for b, s in zip(begins, shift)]), docs, np.array(groups))
            for at in range(0, len(group), ROWS):
                to = at + ROWS
                yield batch(group[at:to], term[at:to].dictionary_decode(), n[at:to], df[at:to])

        def present():
            new = np.arange(len(names))
            return batch(new, pa.array([b""] * len(new), pa.binary()), 0 * new, 0 * new)

        size = entries = 0
        for b in batches:
            of = [names.setdefault(x, len(names)) for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist())]
            text = b.column("text").cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            at = 0
            while at < len(text):
                to = max(int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1, at + 1)  # one text at least
                data = text.buffers()[2].slice(ends[at], ends[to] - ends[at]).to_pybytes() if ends[to] > ends[at] else b""
                if len(data) > SLICE:
                    found = terms(data)
                    yield batch(np.full(len(found), of[at]), pa.array(found.keys(), pa.binary()), list(found.values()), np.ones(len(found), np.int64))
                else:
                    parts.append(cut(data, ends[at + 1 : to + 1] - ends[at]))
                    groups += of[at:to]
                    size += len(parts[-1][0])
                    entries += len(parts[-1][1])
                at = to
                if entries > ENTRIES or size > BYTES or len(groups) > DOCS:
                    yield from flush()
                    parts, groups, size, entries = [], [], 0, 0
            if len(names) > DOCS:
                if parts:
                    yield from flush()
                yield present()
                names, parts, groups, size, entries = {}, [], [], 0, 0
        if parts:
            yield from flush()
        yield present()

    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")


def vocabulary(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """docs(lang, source, text) to counts(lang, source, term, n, n_lang) of the kept terms that a group has, and groups(lang, source, total, kinds, v, total_lang)."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    summed = _counted(read).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")  # at most a row for each source
    own = summed.withColumn("df_lang", F.sum("df").over(of_term)).withColumn("n_lang", F.sum("n").over(of_term)).withColumn("first", (F.col("source") == F.min("source").over(of_term)).cast("int"))
    kept = materialize(own.where((F.col("df_lang") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n", "n_lang", "first"), "terms")
    real = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(real.cast("bigint")).alias("kinds"))
    langs = kept.groupBy("lang").agg(F.sum((real & (F.col("first") == 1)).cast("bigint")).alias("v"), F.sum("n").alias("total_lang"))
    return kept.where(real).drop("first"), materialize(groups.join(langs, "lang"), "groups")


def _p(n: str, total: str) -> str:
    """SQL of a term's share: in decimals where counts pass what SCALE leaves of a long."""
    wide = f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} as decimal(20,0)) as bigint)"
    return f"case when {n} < {LONG // SCALE} then 1 + ({SCALE}L * ({n} + 1)) div ({total}) else {wide} end"


def _f(p: str, q: str) -> str:
    """SQL of the divergence; both are at most SCALE + 1, so the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _sum(x: str) -> str:
    """SQL of an exact sum of longs, as decimal: their halves are summed as longs, which 2^31 rows can't fill."""
    return f"cast(sum(shiftright({x}, 32)) as decimal(19,0)) * 4294967296 + cast(sum({x} & 4294967295L) as decimal(19,0))"


def _by_group(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to state, which has a row for each group: by broadcast if its counted size allows, else by shuffle, where Spark splits what a hot group fills."""
    return rows.join(F.broadcast(state) if state.count() <= GROUPS else state, keys)


def radix_select(rows: DataFrame, keys: list[str], value: str, item: str, k: int) -> DataFrame:
    """The k rows of each group (keys) that come first by value (a long, not negative) descending and then by the item's UTF-8 bytes ascending, with rank from 1. rows are read once for each round, so give them as a written table. Of rows that repeat group, value and item any may be taken."""
    rows = rows.select(*keys, F.col(value).alias("value_"), F.col(item).alias("item_"))
    # a group's bin holds the values from low to high, and of these the items that begin with head (hex); need of its size rows are wanted
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("value_").alias("low"), F.max("value_").alias("high"))
    ahead = "when low = high then 'items' else 'bits' end as step"
    state = state.selectExpr(*keys, f"cast({k} as bigint) as need", "size", "low", "high", "cast('' as string) as head", f"case when size <= {k} then 'all' {ahead}")
    own = state.columns
    order = Window.partitionBy(*keys)

    def crossed(bins: DataFrame, by) -> DataFrame:
        """The bin of each group where the rows of the bins up to it reach need, of which the bins before take their part."""
        sums = bins.withColumn("sum", F.sum("n").over(order.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
        return sums.where("sum >= need and sum - n < need").withColumn("need", F.col("need") - F.col("sum") + F.col("n"))

    def by_bits(state: DataFrame) -> DataFrame:
        inside = joined(rows, state.select(*keys, "need", "low", "high")).where("value_ between low and high").withColumn("above", F.expr("value_ - low"))
        # the number of bits beyond the first few of them, then these few: greater values never have less of both together
        inside = inside.withColumn("shift", F.expr(f"greatest(length(bin(above)) - {BITS - 5}, 0)"))
        digit = F.expr(f"shiftleft(cast(shift as bigint), {BITS - 6}) + shiftright(above, shift)").alias("digit")
        bins = inside.groupBy(*keys, "need", digit).agg(F.count(F.lit(1)).alias("n"), F.min("value_").alias("low"), F.max("value_").alias("high"))
        return crossed(bins, F.desc("digit")).selectExpr(*keys, "need", "n as size", "low", "high", "cast('' as string) as head", f"case when need = n or n <= {FEW} then 'all' {ahead}")

    def by_items(state: DataFrame) -> DataFrame:
        inside = joined(rows, state.select(*keys, "need", "low", "head")).withColumn("hex", F.hex(F.col("item_").cast("binary"))).where("value_ = low and startswith(hex, head)")
        ends = inside.groupBy(*keys).agg(F.min("hex").alias("a"), F.max("hex").alias("b"))
        differ = F.expr("array_position(transform(sequence(1, length(a) + 1), i -> substring(a, i, 1) <> substring(b, i, 1)), true)")  # the first of all items is not longer than what follows it where they agree
        ends = ends.select(*keys, F.when(F.col("a") == F.col("b"), F.length("a")).otherwise(F.floor((differ - 1) / 2) * 2).cast("int").alias("at"), (F.col("a") == F.col("b")).alias("same"))
        ends = materialize(ends, "select")
        bins = joined(inside, ends).groupBy(*keys, "need", "low", "same", F.expr(f"substring(hex, 1, at + {2 * WIDTH})").alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        return crossed(bins, F.asc("digit")).selectExpr(*keys, "need", "n as size", "low", "low as high", "digit as head", "case when need = n or same then 'some' else 'items' end as step")

    steps, done, n_groups = {"bits": by_bits, "items": by_items}, None, None
    while state is not None:
        state = materialize(state.select(*own), "select")
        found = {r["step"]: r["n"] for r in state.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few names
        n_groups = sum(found.values()) if n_groups is None else n_groups
        joined = lambda left, right, few=n_groups <= GROUPS: left.join(F.broadcast(right) if few else right, keys)
        ready = state.where("step in ('all', 'some')")
        done = ready if done is None else done.unionByName(ready)
        parts = [f(state.where(F.col("step") == name)) for name, f in steps.items() if name in found]
        state = None
        for p in parts:
            state = p if state is None else state.unionByName(p)
    kept = joined(rows, done.select(*keys, "low", "head", "step")).where("value_ > low or value_ = low and (step = 'all' or substring(hex(cast(item_ as binary)), 1, length(head)) <= head)")
    rank = F.row_number().over(order.orderBy(F.desc("value_"), F.asc("item_")))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, F.col("item_").alias(item), F.col("value_").alias(value), "rank")


def source_pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value: the divergence of the source from the other, summed over all kept terms."""
    zero = _p("0", "total + v")
    own = groups.selectExpr("lang", "source", "v", "kinds", f"case when v > 0 then {zero} else 1 end as p0", "total")
    rows = _by_group(counts, own.select("lang", "source", "v", "total", "p0"), ["lang", "source"]).selectExpr("lang", "source", "term", f"{_p('n', 'total + v')} as p", "p0")
    rows = materialize(rows, "shares")
    # terms of one, as if the other lacked them
    few = own.count() <= GROUPS
    of_p = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    other = own.selectExpr("lang", "source as item", "p0 as q0")
    alone = of_p.join(F.broadcast(other) if few else other, "lang").where("source <> item")
    d = "decimal(38,0)"
    alone = alone.groupBy("lang", "source", "item").agg(F.expr(f"sum(cast(n as {d}) * cast({_f('p', 'q0')} as decimal(19,0)))").alias("one"), F.expr(f"sum(cast(n as {d}) * cast({_f('q0', 'p')} as decimal(19,0)))").alias("two"))
    # terms of both
    a = rows.selectExpr("lang", "term", "source", "p", "p0")
    b = rows.selectExpr("lang", "term", "source as item", "p as q", "p0 as q0")
    there, back = f"{_f('p', 'q')} - {_f('p', 'q0')} - {_f('p0', 'q')} + {_f('p0', 'q0')}", f"{_f('q', 'p')} - {_f('q', 'p0')} - {_f('q0', 'p')} + {_f('q0', 'p0')}"
    both = a.join(b, ["lang", "term"]).where("source < item").selectExpr("lang", "source", "item", f"{there} as x", f"{back} as y")
    both = both.groupBy("lang", "source", "item").agg(F.expr(_sum("x")).alias("x"), F.expr(_sum("y")).alias("y"))
    both = both.select("lang", F.inline(F.array(F.struct("source", "item", F.col("x").alias("common")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("y").alias("common")))))
    # every ordered pair of a language's sources is a row of the result
    left, right = own.selectExpr("lang", "source", "v", "kinds", "p0"), own.selectExpr("lang", "source as item", "kinds as kinds_b", "p0 as q0")
    pairs = left.join(F.broadcast(right) if few else right, "lang").where("source <> item")
    pairs = pairs.join(alone.select("lang", "source", "item", "one"), ["lang", "source", "item"], "left")
    pairs = pairs.join(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "two"), ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    base = f"cast({_f('p0', 'q0')} as decimal(19,0))"
    value = f"cast(case when v = 0 then 0 else cast(v - kinds - kinds_b as decimal(19,0)) * {base} + coalesce(one, 0) + coalesce(two, 0) + coalesce(common, 0) end as bigint)"
    return pairs.selectExpr("lang", "source", "item", f"{value} as value")


def source_terms(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the top terms that a source has more of than its language, by their divergence."""
    rows = _by_group(counts, groups, ["lang", "source"]).selectExpr("lang", "source", "term as item", f"{_p('n', 'total + v')} as p", f"{_p('n_lang', 'total_lang + v')} as q")
    rows = rows.where("p > q").selectExpr("lang", "source", "item", f"{_f('p', 'q')} as value")
    return radix_select(materialize(rows, "values"), ["lang", "source"], "value", "item", top)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    counts, groups = vocabulary(table(spark, sf_dir, "documents"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(counts, groups).withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(source_terms(counts, groups).withColumn("part", F.lit("term")).select(*columns))


_SHARE = "1 + (1000000000::HUGEINT * ({} + 1)) // (sum({}) OVER w + count(*) OVER w)"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS nl FROM o GROUP BY ALL HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, nl, coalesce(n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, {_SHARE.format("n", "n")} AS p, {_SHARE.format("nl", "nl")} AS q FROM x WINDOW w AS (PARTITION BY lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
