"""Secret scans with an incremental blob ledger.

A version is one state of one path: a row with a text. Its content address is the SHA-256 of the text, so however many paths and versions share a text, it is one blob. The ledger is a table with a row for each blob and update: which rules, each with its version, the blob was scanned by, and the spans they found. An update

1. addresses all versions (a digest for each row; texts don't move) and groups the digests, so that a third of all rows with one text sends one row from each map task,
2. takes from the blobs' wanted rules those that the ledger has: what is left are the unseen pairs of blob and rule version; blobs without any are done,
3. reads the text of one row of each blob that is left, scans it by its unseen rules only, and appends what it found to the ledger in one write. A run that dies before the write is committed has changed nothing; one that is repeated finds nothing unseen,
4. joins the spans of the current rule versions back to all paths by digest, hot digests by broadcast.

The row to read is chosen by a hash of its id, so texts are joined to the wanted blobs on digest and hash, a key that only rows repeated as a whole share. Wanted blobs that take no more than spark.sql.autoBroadcastJoinThreshold (their rows are counted, ROW_BYTES each) are broadcast, and then no text is moved at all; more are hashed where the texts arrive, without sorting them. The ledger and the table of addresses are written tables in the shared folder.

Rules are patterns over ASCII, read on UTF-8 bytes, where ASCII never is part of another character; spans are code points, end exclusive. A rule's matches are leftmost and don't overlap; a match whose group is shorter than least is dropped.

Defined results: a null text counts as empty, an empty text has no span. Ids may be null or repeat; each row comes back once. A row without any span has empty lists. An empty table gives no rows and leaves the ledger as it was. Columns named in keep come through under their names, others are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, scratch, skew_join, small_batches, table

#: What a wanted blob takes: its digest, a hash and the names of the rules.
ROW_BYTES = 200


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules, then well-known formats of published tokens and keys.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # as long runs are whole, the runs of 24 and more
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
ENTRIES = "digest binary, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


def scan(data: bytes, rules) -> list[tuple[str, int, int]]:
    """(rule, start, end) of UTF-8 text by compiled rules, in the rules' order, in code points."""
    found = []
    for name, pattern, group, least in rules:
        for m in pattern.finditer(data):
            a, b = m.span()
            if (b - a if not group else len(m[group])) >= least:
                found.append((name, a, b))
    if found and not data.isascii():
        at, points, place = 0, 0, {}
        for x in sorted({y for _, a, b in found for y in (a, b)}):
            points += len(data[at:x].decode())
            place[x], at = points, x
        found = [(name, place[a], place[b]) for name, a, b in found]
    return found


class Ledger:
    """What was scanned, at a path that all executors share. Rows are appended, one write for each update, and never changed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """path: a ledger that exists or will; by default a new one in the shared folder."""
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def entries(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(ENTRIES).parquet(self.path) if there else self.spark.createDataFrame([], ENTRIES)

    def unseen(self, blobs: DataFrame, rules) -> DataFrame:
        """blobs(digest, ...), each once, with the column rules: the names of those among rules that the ledger lacks; blobs that lack none are left out."""
        seen = self.entries().groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        every = F.array(*[F.lit(r.name) for r in rules])
        rows = blobs.join(seen, "digest", "left").withColumn("rules", F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen"))))
        return rows.where(F.size("rules") > 0).drop("seen")

    def spans(self, rules) -> DataFrame:
        """digest, spans of all blobs with a span of one of rules, sorted by start and the rules' order: start, end, kind."""
        place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        own = F.filter("spans", lambda s: F.element_at(place, s["rule"]).isNotNull())
        rows = self.entries().select("digest", F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["rule"]).alias("place"), s["end"].alias("end"))).alias("spans")).where(F.size("spans") > 0)
        rows = rows.groupBy("digest").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        return rows.select("digest", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["place"] + 1).alias("kind"))).alias("spans"))

    def update(self, versions: DataFrame, addresses: DataFrame, rules=RULES) -> int:
        """Scans what is unseen of versions(doc_id, text); addresses: their (digest, lot), written. Returns how many blobs were scanned."""
        blobs = addresses.groupBy("digest").agg(F.min("lot").alias("lot"))
        wanted = materialize(self.unseen(blobs, rules), "unseen")
        n = wanted.count()
        if not n:
            return 0
        most = self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
        side = F.broadcast(wanted) if n * ROW_BYTES <= most else wanted.hint("shuffle_hash")
        texts = _addressed(versions).select("digest", "lot", "text").join(side, ["digest", "lot"]).select("digest", "rules", "text")
        small_batches(self.spark)
        patterns = {r.name: (r.name, r.pattern, r.group, r.least) for r in rules}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compiled = {k: (name, re.compile(p.encode()), g, n) for k, (name, p, g, n) in patterns.items()}
            span = pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            for b in batches:
                by = [[compiled[x] for x in names] for names in b.column("rules").to_pylist()]
                found = [[dict(zip(("rule", "start", "end"), s)) for s in scan(t.as_buffer().to_pybytes(), r)] for t, r in zip(b.column("text").cast(pa.binary()), by)]
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("rules"), pa.array(found, pa.list_(span))], ["digest", "rules", "spans"])

        texts.mapInArrow(run, ENTRIES).write.mode("append").parquet(self.path)
        return n


def _addressed(versions: DataFrame) -> DataFrame:
    """versions with digest, lot (a hash of the id) and text without nulls, beside a struct of the whole row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.xxhash64("doc_id").alias("lot"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in versions.columns]).alias("row"))


def audit(versions: DataFrame, *keep: str, ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """versions(doc_id, text, ...): brings the ledger up to date with them and returns, for every row, the columns keep, digest and spans (start, end, kind; sorted by start, then by the rules' order) by the current rules."""
    ledger = ledger or Ledger(versions.sparkSession)
    own = _addressed(versions).select("digest", "lot", *[F.col("row").getField(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    own = materialize(own, "addresses")
    ledger.update(versions, own.select("digest", "lot"), rules)
    rows = skew_join(own.drop("lot"), ledger.spans(rules), "digest", own.count())
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return rows.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "digest", F.coalesce("spans", none).alias("spans"))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = audit(table(spark, sf_dir, "documents"), "doc_id")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *[own(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _kind_sql(i: int, rule: Rule) -> str:
    """The matches of a rule: gaps between matches and matches in turn give their places."""
    p = rule.pattern.replace("'", "''")
    length = f"length(regexp_extract(m, '{p}', {rule.group}))" if rule.group else "length(m)"
    at = "list_transform(range(1, len(m) + 1), lambda j: CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT))"
    return f"SELECT i, {i} AS place, '{rule.kind}' AS kind, unnest({at}) AS a, unnest(m) AS m FROM (SELECT i, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d) WHERE len(m) > 0", length, rule.least


def _spans_sql() -> str:
    each = []
    for i, r in enumerate(RULES):
        body, length, least = _kind_sql(i, r)
        each.append(f"SELECT i, place, kind, a, a + length(m) AS b FROM ({body}) WHERE {length} >= {least}")
    return " UNION ALL ".join(each)


_BASE = ", ".join(f"'{k}'" for k in BASE)
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql()}),
f AS (SELECT i, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) FILTER (kind IN ({_BASE})) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM s GROUP BY i)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON f.i = d.i
"""
