"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has bit b where more than half of its shingles' 64-bit hashes have it. Fingerprints that differ in at most TAU bits are linked, and links joined to components.

Candidates. The 64 bits lie in a ring of M segments. If two fingerprints differ in at most TAU bits in all, some segment starts a chain whose first l segments differ in at most floor(l * TAU / M) bits, for every l (the pigeonring principle). With M = 5 and TAU = 2 the budgets are 0, 0, 1, 1, 2: the first two segments are equal, so they are the key of a hash table, one table for each start, and the longer chains prune before the full Hamming check.

Large buckets. Distinct fingerprints only are compared, so copies cost nothing. A bucket of more than SMALL rows isn't compared pair by pair: as at most two bits differ in its other three segments, one of these is equal too, and its rows are dealt again by that third segment. What is left there has 25 free bits, hence a bounded size, and is linked by sorting once under each mask of two bits, without forming pairs. Every link is found in one of these ways; none is capped.

Defined results: null text counts as empty; no word gives fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is one shingle. Null ids are ignored in component ids (null if there is no other). Repeated rows get the same row twice. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, skew_join, small_batches, table

SHINGLE, SEED, TAU, M, SMALL = 3, 42, 2, 5, 64
WIDTHS = [64 // M + (i < 64 % M) for i in range(M)]
STARTS = [sum(WIDTHS[:i]) for i in range(M)]
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """SimHash of the shingles of UTF-8 text; A-Z count as a-z."""
    words = data.lower().split()  # bytes: splits at 0x20 and 0x09-0x0D, lowers A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    one = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        h = np.fromiter((one(line[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())), np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns keep, and fp (the 64 bits as a long) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"))
    own = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text_").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(fp.view(np.int64))], [*own, "fp"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1]), "fp bigint"]))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(STARTS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def close(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs keep the budget of every chain from their table's start; the longest chain is the full check."""
    x = a ^ b
    each = np.stack([np.bitwise_count(_segment(x, i)).astype(np.int64) for i in range(M)], axis=1)
    ring = np.cumsum(each[np.arange(len(x))[:, None], (start[:, None] + np.arange(M)) % M], axis=1)
    return (ring <= (np.arange(1, M + 1) * TAU) // M).all(axis=1)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = b["fp"].to_numpy().view(np.uint64)
        parts = []
        for i in range(M):
            key = (_segment(fp, i) << np.uint64(16)) | _segment(fp, (i + 1) % M)
            parts.append(pd.DataFrame({"key": ((key << np.uint64(4)) | np.uint64(i)).view(np.int64), "fp": fp.view(np.int64)}))
        yield pd.concat(parts)


def _small_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, fp) to links; rows of a bucket of more than SMALL rows come back with a null partner."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    large = None  # the key of a large bucket that may go on

    def work(key: np.ndarray, fp: np.ndarray, large: int | None) -> pd.DataFrame:
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.repeat(np.diff(np.r_[at, len(key)]), np.diff(np.r_[at, len(key)]))
        big = (size > SMALL) | (key == large if large is not None else False)
        out = [pd.DataFrame({"key": key[big], "a": fp[big], "b": pd.array([None] * int(big.sum()), "Int64")})]
        k, f = key[~big], fp[~big]
        for d in range(1, SMALL):
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            a, b = f[same], f[same + d]
            ok = close(a.view(np.uint64), b.view(np.uint64), (k[same] & 15).astype(np.int64))
            out.append(pd.DataFrame({"key": k[same][ok], "a": a[ok], "b": pd.array(b[ok], "Int64")}))
        return pd.concat(out)

    for x in batches:
        key, fp = np.r_[key, x["key"].to_numpy()], np.r_[fp, x["fp"].to_numpy()]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if len(key) - cut > SMALL or key[-1] == large:
            yield work(key, fp, large)
            large, cut = key[-1], len(key)
        elif cut:
            yield work(key[:cut], fp[:cut], large)
        key, fp = key[cut:], fp[cut:]
    if len(key):
        yield work(key, fp, large)


def _refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large buckets, dealt by each of the three segments outside the key."""
    for b in batches:
        key, fp = b["key"].to_numpy(), b["a"].to_numpy()
        for j in range(2, M):
            start = (key & 15).astype(np.int64)
            third = np.choose((start + j) % M, [_segment(fp.view(np.uint64), i) for i in range(M)]).astype(np.int64)
            yield pd.DataFrame({"key": key, "j": j, "third": third, "fp": fp})


def _forest(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what is within two bits, as a forest: equal values under a mask of two bits are linked."""
    label = np.arange(len(fp))
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << i for i in range(64) if free >> i & 1]
    left, right = [], []
    for n, p in enumerate(bits):
        for q in bits[n:]:
            masked = fp & np.uint64(~(p | q) & 0xFFFFFFFFFFFFFFFF)
            order = np.argsort(masked, kind="stable")
            near = np.flatnonzero((masked[order[1:]] == masked[order[:-1]]) & (label[order[1:]] != label[order[:-1]]))
            for i, j in zip(order[near].tolist(), order[near + 1].tolist()):
                if (a := root(i)) != (b := root(j)):
                    parent[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(j)
            if len(near):
                label = np.fromiter(map(root, range(len(fp))), np.int64, len(fp))
    return left, right


def _large_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """All rows share three segments, so 25 bits are free and the group is bounded."""
    fp = np.unique(rows["fp"].to_numpy().view(np.uint64))
    left, right = _forest(fp)
    return pd.DataFrame({"a": fp[left].view(np.int64), "b": fp[right].view(np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """fps(fp), each value once, to links(a, b) whose components are those of all pairs within TAU bits."""
    keyed = fps.select("fp").mapInPandas(_keys, "key bigint, fp bigint")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_small_buckets, "key bigint, a bigint, b bigint")
    found = materialize(found, "links")
    large = found.where("b is null").select("key", "a").mapInPandas(_refine, "key bigint, j int, third bigint, fp bigint")
    more = large.groupBy("key", "j", "third").applyInPandas(_large_bucket, "a bigint, b bigint")
    return found.where("b is not null").select("a", "b").unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (v, root) for every vertex of an edge, root the smallest vertex reachable: large-star and small-star rounds on distributed edges, each written out, until nothing changes."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    seen = None
    while True:
        edges = materialize(edges, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select(F.col("v"), F.col("v").alias("root")).distinct())
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select("v", "m").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def cluster(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns keep, fp, component_id (the smallest doc_id of the component) and group (a fingerprint that stands for it) of every row."""
    rows = materialize(fingerprints(docs, *keep), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    n = classes.agg(F.sum("n")).first()[0] or 0
    roots = materialize(components(links(classes)), "roots")
    linked = classes.join(roots.withColumnRenamed("v", "fp"), "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = skew_join(linked.select("fp", "root"), of_root, "root", n, "inner").select("fp", "root", "component_id")
    whole = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("group"))
    return skew_join(rows, whole, "fp", n, "inner").select("doc_id", *keep, "fp", "component_id", "group")


def near_deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with the columns of docs: the one with the smallest doc_id, null ids last, and of rows that share it the one whose text has the smallest SHA-256. Null texts count as empty; of rows that repeat both one stays."""
    own = docs.columns
    of_text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    found = materialize(cluster(docs.select("doc_id", "text", of_text.alias("of_text")), "of_text"), "components")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))  # also for components that have null ids only
    drop = found.where(~first).select(F.col("doc_id").alias("id_"), F.col("of_text").alias("of_")).distinct()
    again = materialize(found.where(first).groupBy("group").agg(F.min("of_text").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "least"), "again")
    some = not again.isEmpty()
    if some:  # several rows have the component's smallest id
        drop = drop.unionByName(found.where(first).join(again, "group").where("of_text <> least").select(F.col("doc_id").alias("id_"), F.col("of_text").alias("of_")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").alias("id"), of_text.alias("of"))
    rest = rows.join(drop, F.col("id").eqNullSafe(F.col("id_")) & (F.col("of") == F.col("of_")), "left_anti")
    if some:
        rest = rest.dropDuplicates(["id", "of"])
    return rest.select(*[F.col("row").getField(c).alias(c) for c in own])


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
