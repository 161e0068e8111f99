"""Rankers over text: queries(qid, text) and docs(docid, text), ids unlike, to rankings.

The corpus is read and tokenised once: tokens are exploded in the scan's own tasks, met there with the queries' words, and counted in parts, so what is shuffled and written is a row for each document and query word, and one for each document. Every statistic (document and collection frequencies, lengths, numbers of documents) comes from this table. A document that is given several times counts once. Rankers that score given candidates read the candidates' texts only, each once, whatever the number of queries it is a candidate of. Queries are the small side by nature; their words are broadcast after their size was checked, and joined by shuffle beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.exact import exact_ranking, exact_scores
from rankloom.functions.tables import written
from rankloom.functions.text import bigrams, tokenize, tokenize_raw
from rankloom.operators.ranking import ranking

#: Fixed values of the published models.
BM25, BM25_TUNED, MU = (1.2, 0.75), (0.9, 0.4), 2000
#: What may be broadcast at most, counted before.
ROWS, BYTES = 1 << 20, 1 << 25


def few(rows: DataFrame) -> bool:
    """Whether the counted size of rows allows a broadcast."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return size["n"] <= ROWS and (size["bytes"] or 0) <= BYTES


def _side(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


class Collection:
    """Counts over all documents for the queries' words: tf(docid, dl, term, tf), terms(term, df, cf), totals(n, avg_dl, c), and words(qid, term, qtf), in which a word that a query repeats counts as often. Rows that share a docid are one document: the text with the smallest hash, once."""

    def __init__(self, queries: DataFrame, docs: DataFrame, tokens: Callable[[Column], Column] = tokenize):
        words = written(queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")), "words")
        self.few = few(words)  # of the words, hence of all that has at most one row for each of them
        self.words = _side(words, self.few)
        read = docs.select("docid", F.xxhash64("text").alias("of"), tokens(F.col("text")).alias("tokens"))
        # the empty term stands for the document itself, so that none is lost and its repetitions are counted
        terms = read.select("docid", "of", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
        known = words.select("term").distinct().unionByName(words.sparkSession.createDataFrame([("",)], "term string"))
        counts = terms.join(_side(known, self.few), "term", "left_semi").groupBy("docid", "of", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        counts = written(counts, "counts")
        given = counts.where("term = ''")
        if not given.groupBy("docid").agg(F.sum("tf").alias("n")).where("n > 1").isEmpty():
            own = Window.partitionBy("docid")
            counts = counts.withColumn("first", F.min("of").over(own)).where("of = first").withColumn("times", F.max(F.when(F.col("term") == "", F.col("tf"))).over(own))
            counts = written(counts.withColumn("tf", F.expr("tf div times")).drop("first", "times"), "counts")
        self.tf = counts.where("term <> ''").select("docid", "dl", "term", "tf")
        self.terms = self.tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        self.totals = counts.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"), F.sum("dl").alias("c"))

    def weighted(self) -> DataFrame:
        """words with df, cf and the totals: a row for each query word that some document has."""
        return self.words.join(self.terms, "term").join(F.broadcast(self.totals), F.lit(True))

    def matched(self) -> DataFrame:
        """One row for each query word and document that has it, with all counts. With few words nothing is shuffled by word, so a common one burdens no task."""
        return self.tf.join(_side(self.weighted(), self.few), "term")


def bm25(c: Collection, k1: float = BM25[0], b: float = BM25[1], depth: int = 200, raw: bool = False) -> DataFrame:
    """Scores are sums without error, so rows' order never tells equal documents apart; raw: in the order of these sums instead of them rounded to ten digits. A document's share of the mean length is that of its exact product with b, a decimal."""
    share = (F.col("dl") * F.lit(Decimal(str(b)))).cast("double")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (float(1 - Decimal(str(b))) + share / F.col("avg_dl")))
    parts = c.matched().select("qid", "docid", part.alias("x"))
    return exact_ranking(parts, None, depth) if raw else ranking(exact_scores(parts), None, depth)


def tfidf(c: Collection, depth: int = 200) -> DataFrame:
    part = F.col("qtf") * (1 + F.ln("tf")) * F.ln(F.col("n") / (F.col("df") + 1))
    return ranking(c.matched().groupBy("qid", "docid").agg((F.sum(part) / F.sqrt(F.max("dl"))).alias("score")), None, depth)


def ql_dirichlet(c: Collection, mu: int = MU, depth: int = 200) -> DataFrame:
    """Query likelihood. A query word that a candidate lacks counts as well; candidates have at least one, so its share is that of an absent word, plus what having it changes: no join of words to candidates that lack them. Words that no document has are left out."""
    p = mu * F.col("cf") / F.col("c")
    absent = c.weighted().groupBy("qid").agg(F.sum(F.col("qtf") * F.ln(p)).alias("base"), F.sum("qtf").alias("words"))
    got = c.matched().groupBy("qid", "docid").agg(F.sum(F.col("qtf") * F.ln((F.col("tf") + p) / p)).alias("gain"), F.max("dl").alias("dl"))
    return ranking(got.join(_side(absent, c.few), "qid").select("qid", "docid", (F.col("base") + F.col("gain") - F.col("words") * F.ln(F.col("dl") + mu)).alias("score")), None, depth)


def candidate_texts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The texts of candidates(qid, docid): docid, text, once for each docid. Of rows that share one the text with the smallest hash counts, as in a Collection; texts are grouped only if some do."""
    wanted = candidates.select("docid").distinct()
    side = _side(wanted, few(wanted))
    if docs.select("docid").join(side, "docid", "left_semi").groupBy("docid").count().where("count > 1").isEmpty():
        return docs.join(side, "docid", "left_semi").select("docid", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(side, "docid", "left_semi").select("docid", F.xxhash64("text").alias("of"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("docid").agg(F.min_by("text", "of").alias("text"))


def _spread(candidates: DataFrame) -> DataFrame:
    """qid, docid in as many partitions as a shuffle has: each row grows to a text's features later, so few small partitions would become few great ones."""
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return candidates.select("qid", "docid").repartition(n, "docid")


def _counts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Each row's hashes hs, repeated ones once, with their numbers."""
    for b in batches:
        found = [np.unique(np.asarray(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], np.int64), return_counts=True) for x in b.column("hs")]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(key), pa.array([h for h, _ in found], kind), pa.array([n for _, n in found], kind)], [key, "hs", "tfs"])


def _cosines(rows: pd.DataFrame) -> pd.DataFrame:
    """One query's texts (docid, empty for the query itself; hs and tfs: hashes and counts of their features) to qid, docid, score."""
    hs = [np.asarray(x if x is not None else [], np.int64) for x in rows["hs"]]
    tf = np.concatenate([np.asarray(x if x is not None else [], float) for x in rows["tfs"]])
    own = (rows["docid"] == "").to_numpy()
    n, text = len(rows) if own.any() else len(rows) + 1, np.repeat(np.arange(len(rows)), list(map(len, hs)))
    _, at, df = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
    fit = (df >= 2) & (df < 0.95 * n)
    w = (1 + np.log(tf)) * (np.log(n / (df + 1)) * (fit if fit.any() else 1))[at]
    query = np.bincount(at[own[text]], w[own[text]], len(df))
    dot, norm = np.bincount(text, w * query[at], len(rows)), np.sqrt(np.bincount(text, w * w, len(rows)) * (query @ query))
    score = np.divide(dot, norm, out=np.zeros(len(rows)), where=norm > 0)
    return pd.DataFrame({"qid": rows["qid"], "docid": rows["docid"], "score": score})[~own]


def bigram_cosine(queries: DataFrame, docs: DataFrame, candidates: DataFrame, depth: int | None = None) -> DataFrame:
    """Cosine of words and pairs for candidates(qid, docid). Weights are 1 + ln tf times ln(n / (df + 1)), counted over a query's candidates and itself; features in one of them only, or in 95 hundredths and more, are left out, unless that leaves none. A text without such features scores 0. Features are counted once for each text, in the row, by their 64-bit hashes; then a query is one task's vectors, bounded by its candidates, a parameter of the caller."""

    def features(rows: DataFrame, key: str) -> DataFrame:
        read = rows.select(key, tokenize(F.col("text")).alias("tokens"))
        hashed = read.select(key, F.transform(F.concat("tokens", bigrams(F.col("tokens"))), lambda f: F.xxhash64(f)).alias("hs"))
        return hashed.mapInArrow(lambda batches: _counts(batches, key), f"{key} {dict(rows.dtypes)[key]}, hs array<bigint>, tfs array<bigint>")

    pairs = _spread(candidates)
    rows = pairs.join(features(candidate_texts(docs, candidates), "docid"), "docid", "left").select("qid", "docid", "hs", "tfs")
    rows = rows.unionByName(features(queries, "qid").select("qid", F.lit("").alias("docid"), "hs", "tfs").join(pairs.select("qid").distinct(), "qid", "left_semi"))
    kinds = dict(rows.dtypes)
    return ranking(rows.groupBy("qid").applyInPandas(_cosines, f"qid {kinds['qid']}, docid {kinds['docid']}, score double"), None, depth)


def matching(queries: DataFrame, docs: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """qid, docid of all documents with at least one of the query's words."""
    c = Collection(queries, docs, tokens)
    return c.tf.join(c.words, "term").select("qid", "docid").distinct()


#: Queries that a candidate text is evaluated for in one row, about; and cells of a table of places at once.
TOGETHER, CELLS = 500, 1 << 21
RAW = re.compile("[a-z0-9]+")


def _nearest(place: np.ndarray, word: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hits in order of their places, by words: the first place (infinite if none), and the least distance of each two words. Every hit looks back at the last place of each word, slice after slice."""
    first, near, last = np.full(m, np.inf), np.full((m, m), np.inf), np.full(m, -np.inf)
    step = max(1, CELLS // m)
    for at in range(0, len(place), step):
        p, w = place[at : at + step].astype(float), word[at : at + step]
        seen = np.full((len(p) + 1, m), -np.inf)
        seen[0] = last
        seen[np.arange(1, len(p) + 1), w] = p
        np.maximum.accumulate(seen, axis=0, out=seen)
        back = p[:, None] - seen[:-1]
        order = np.argsort(w, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(w[order]) != 0])
        own = w[order][begin]
        near[own] = np.minimum(near[own], np.minimum.reduceat(back[order], begin, axis=0))
        first[own] = np.minimum(first[own], p[order][begin])
        last = seen[-1]
    return first, np.minimum(near, near.T)


def _proximities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """qid, docid, score of rows(docid, low, asked): each lower-case text is split once, for all queries that ask for it."""
    for b in batches:
        out = [[] for _ in range(3)]
        for docid, low, asked in zip(b.column("docid").to_pylist(), b.column("low").to_pylist(), b.column("asked").to_pylist()):
            tokens = RAW.findall(low)
            number: dict[str, int] = {}
            every = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
            order = np.argsort(every, kind="stable")
            starts = np.searchsorted(every[order], np.arange(len(number) + 1))
            for q in asked:
                terms, score = q["terms"], 0.0
                m = len(terms)
                if tokens:
                    have = [(i, number[t]) for i, t in enumerate(terms) if t in number]
                    spots = [order[starts[n] : starts[n + 1]] for _, n in have]
                    close = early = 0.0
                    if have:
                        place = np.concatenate(spots)
                        by = np.argsort(place, kind="stable")
                        first, near = _nearest(place[by], np.repeat(np.arange(len(have)), [len(x) for x in spots])[by], len(have))
                        early = float((1 / (1 + first)).sum())
                        close = float((1 / (1 + near[np.triu_indices(len(have), 1)])).sum())
                    phrase = 0.0 if m < 2 else 1.0 if q["query"] in low else min(1.0, 0.3 * sum(f"{x} {y}" in low for x, y in zip(terms, terms[1:])))
                    score = 0.2 * len(have) / m + 0.4 * close / max(m * (m - 1) / 2, 1) + 0.15 * early / m + 0.25 * phrase
                for col, v in zip(out, (q["qid"], docid, score)):
                    col.append(v)
        kinds = (b.schema.field("asked").type.value_type.field("qid").type, b.schema.field("docid").type, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["qid", "docid", "score"])


def proximity(queries: DataFrame, docs: DataFrame, candidates: DataFrame, depth: int | None = None) -> DataFrame:
    """For candidates(qid, docid): .20 share of query words found, .40 mean over all pairs of query words of 1 / (1 + nearest distance) (0 for a pair that isn't found), .15 mean over all query words of 1 / (1 + first place), .25 for phrases: 1 if the text holds the whole query, else .3 for each two neighbouring query words that it holds side by side, at most 1. Query words are distinct, in the order of their first places. A query may have any number of them.

    Queries go to the texts: about TOGETHER of those that have a text among their candidates are a row, and meet the text once; it is made lower-case and split once for all of them, and numbers come back. A text that very many queries ask for is several rows."""
    own = queries.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("query"), F.array_distinct(tokenize_raw(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    small = few(own)
    share = max(1, own.count() // TOGETHER)
    pairs = candidates.select("qid", "docid").distinct().join(_side(own, small), "qid").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(share)))
    asked = pairs.groupBy("docid", "part").agg(F.collect_list(F.struct("qid", "query", "terms")).alias("asked"))
    rows = asked.join(candidate_texts(docs, candidates), "docid").select("docid", F.lower("text").alias("low"), "asked")
    kinds = dict(pairs.dtypes)
    return ranking(rows.mapInArrow(_proximities, f"qid {kinds['qid']}, docid {kinds['docid']}, score double"), None, depth)


def _sketch(text: str, buckets: int, signs: np.ndarray, n: int = 4) -> np.ndarray:
    """Signed sums of the log counts of a text's buckets of four-letter sequences."""
    letters = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(letters) < n:
        return np.zeros(signs.shape[1])
    h = np.zeros(len(letters) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ letters[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at, count = np.unique(h % np.uint64(buckets), return_counts=True)
    return np.log1p(count) @ signs[at.astype(np.int64)]


def semantic_hash(queries: DataFrame, docs: DataFrame, candidates: DataFrame, buckets: int = 1 << 14, dims: int = 256, seed: int = 42, depth: int | None = None) -> DataFrame:
    """For candidates(qid, docid): cosine of projected counts of four-letter sequences (blanks included). Each goes to a bucket by a fixed hash, log counts of buckets to dims sums by fixed signs. Alike on every machine. A text is read once, in Arrow batches; its sketch is dims doubles, whatever its length."""

    def sums(rows: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signs = np.random.default_rng(seed).integers(0, 2, (buckets, dims), np.int8) * 2.0 - 1
            for b in batches:
                v = [_sketch(x.as_py() or "", buckets, signs).tolist() for x in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(v, pa.list_(pa.float64()))], [key, "v"])

        return rows.select(key, "text").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, v array<double>")

    q = _side(sums(queries, "qid").withColumnRenamed("v", "qv"), few(queries))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = candidates.select("qid", "docid").join(sums(candidate_texts(docs, candidates), "docid"), "docid").join(q, "qid")
    norm = F.sqrt(dot("v", "v") * dot("qv", "qv"))
    return ranking(rows.select("qid", "docid", F.coalesce(dot("v", "qv") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("score")), None, depth)
