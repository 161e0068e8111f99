"""WARC archives with revisit resolution.

Headers alone (page id, payload digest, length) are shuffled by digest to find each payload's original, combined before the shuffle; revisits are joined to their originals; then archives are written, in which a repeated payload of at least LEAST_BYTES stands once and other records of it are revisits with fresh headers. Archives are written and committed by Spark's own writer into the shared folder, so a lost executor leaves no half-written archive. They are read back by Content-Length, each file whole; RECORD_BYTES bounds what a file holds on average.

Defined results: null html is an empty payload; a null page_id gives a record without a number, which reads back as null, and is an original only if all ids of its payload are null. A null url has no target line; ASCII control characters and blanks in a url are percent-encoded. Of rows that repeat page_id and html all have the same record type. An empty table gives an archive without records and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, scratch, skew_join, table

LEAST_BYTES, RECORD_BYTES, BROADCAST_ROWS = 1000, 8 << 20, 100_000
END = "\r\n"


def revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """headers(page_id, digest, n) to page_id, digest, original of the records whose payload another stands for."""
    shared = headers.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = materialize(shared, "originals")
    n = shared.agg(F.sum("copies")).first()[0] or 0
    if not n:
        return headers.select("page_id", "digest", F.col("page_id").alias("original")).limit(0)
    some = headers.where(F.col("n") >= least).select("page_id", "digest")
    return skew_join(some, shared.drop("copies"), "digest", n, "inner").where("not page_id <=> original").select("page_id", "digest", "original").distinct()


def _lines(*parts: tuple[str, Column]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat_ws(END, *[F.concat(F.lit(f"{name}: "), value) for name, value in parts])


def _encoded(text: Column, more: str = "") -> Column:
    """text with ASCII control characters, blanks and the characters more as percent escapes."""
    for c in (*more, *map(chr, (*range(33), 127))):
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def _urn(page_id: Column) -> Column:
    return F.when(page_id.isNull(), "<urn:none>").otherwise(F.concat(F.lit("<urn:page:"), _encoded(page_id.cast("string"), "%<>"), F.lit(">")))


def records(pages: DataFrame, found: DataFrame, date: str) -> DataFrame:
    """One text for each row of pages(page_id, url, html): the record without the line ends that close it."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    side = found.select(F.col("page_id").alias("id_"), F.col("digest").alias("digest_"), "original")
    rows = rows.join(side, F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left")
    revisit = F.col("digest_").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "), F.octet_length("html").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    head = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _encoded(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("original")))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.withColumn("block", block).select(F.concat(F.lit("WARC/1.1" + END), head, F.lit(END + END), "block").alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str | None = None) -> None:
    """Writes gzip archives of the rows of pages(page_id, url, html) to path, a folder that all executors reach. date: of all records, now if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    found = materialize(revisits(headers, least), "revisits")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    size = headers.agg(F.avg("n")).first()[0] or 1
    out = records(pages, F.broadcast(found) if few else found, date)
    out.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(RECORD_BYTES / (size + 500)))).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split(END)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = head_end + 4
        end = start + int(head["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed")
        yield head, data[start:end]
        at = end + 4


def _page(urn: str | None) -> str | None:
    return None if urn in (None, "<urn:none>") else unquote(urn[len("<urn:page:") : -1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            out = [[] for _ in range(6)]
            for head, block in parse(gzip.decompress(content.as_py())):
                kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                n = None
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    n, real = len(payload), hashlib.sha1(payload).hexdigest()
                    if real != said:
                        raise ValueError(f"digest of {head['WARC-Record-ID']}")
                for col, v in zip(out, (_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), n, said, kind, _page(head.get("WARC-Refers-To")))):
                    col.append(v)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers"])


def read(spark, path: str, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of archives; a revisit's payload is that of the response it refers to."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.gz").load(path).select("content")
    got = files.mapInArrow(_read, "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers string")
    try:
        got = materialize(got, "records")
    finally:
        spark.conf.set(name, before)
    key = lambda c: F.concat_ws(":", "payload_digest", c)
    ids = [F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to")]
    responses, others = got.where("record_type = 'response'"), got.where("record_type = 'revisit'")
    n = others.count()
    if not n:
        return responses.select(*ids)
    payload = responses.select(key(F.col("page")).alias("key"), F.col("payload_bytes").alias("bytes")).dropDuplicates(["key"])
    joined = skew_join(others.withColumn("key", key(F.col("refers"))), payload, "key", n, "inner").withColumn("payload_bytes", F.col("bytes"))
    return responses.select(*ids).unionByName(joined.select(*ids))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    write(pages, path)
    return read(spark, path, dict(pages.dtypes)["page_id"])


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d) AS o FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> o THEN o END AS refers_to
FROM q
"""
