"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic texts P and unlabelled texts U, without negatives. With class prior p and logistic loss l its risk is p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]): the second term estimates the negatives' risk from unlabelled text, corrected by the prior, and is kept from going below zero; a step that would make it negative goes back up instead.

Features of a text are its distinct lower-case words and their beginnings of STEMS letters. Those count that confirmed texts have significantly more often than unlabelled ones (Z standard deviations).

Training takes a bounded sample: about POSITIVES confirmed rows and UNLABELLED rows of all, confirmed ones among them, as the estimator asks. Both are drawn before any text is moved (rows without id are not drawn): rows that repeat id and text are counted first, and so many of them are drawn as their number times the share of the sample, rounded up or down by a hash, so a row that is repeated any number of times neither floods the sample nor vanishes from it. The drawn ids and hashes, bounded in number, are broadcast. Features are found where the texts lie; the driver keeps each distinct one of the sample once, and of each drawn row their numbers. The prior is the toxic share of all labelled training rows. Scoring reads every whole text, in Arrow batches.

Defined results: null text counts as empty; a text without features has the score of the bias alone. Without confirmed rows all scores are 0. A row with several labels is toxic if one of them says so; a null label says nothing. Repeated rows get the same row twice; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import fold, materialize, small_batches, table

POSITIVES, UNLABELLED, STEMS, Z, LEAST = 3000, 9000, (4, 6, 8), 4.0, 3
STEPS, RATE, L2, SEED, THRESHOLD = 600, 0.05, 1e-4, 11, 0.7
WORDS = regex.compile(r"\p{L}+").findall


def features(text: str) -> set[str]:
    words = set(WORDS(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "~" for w in words if len(w) >= n])
    return out


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        weight = self.weights
        words = set(WORDS(text.lower()))
        f = self.bias
        found = {w for w in words if w in weight}
        for n in STEMS:
            found.update([s for w in words if len(w) >= n and (s := w[:n] + "~") in weight])
        for x in sorted(found):
            f += weight[x]
        return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(positive: list, unlabelled: list, prior: float, steps: int = STEPS) -> Classifier | None:
    """Adam on the non-negative risk over the whole sample of texts' features."""
    if not positive or not unlabelled:
        return None
    sets = [*positive, *unlabelled]
    n_p, n_u = len(positive), len(unlabelled)
    in_p, in_u = Counter(), Counter()
    for s in positive:
        in_p.update(s)
    for s in unlabelled:
        in_u.update(x for x in s if x in in_p)
    names = []
    for x, n in in_p.items():
        base = (in_u[x] + 1) / (n_u + 2)
        if n >= LEAST and (n - n_p * base) / np.sqrt(n_p * base * (1 - base) + 1e-9) >= Z:
            names.append(x)
    names.sort()
    at = {x: i for i, x in enumerate(names)}
    has = [np.fromiter((at[x] for x in s if x in at), np.int32) for s in sets]
    return _descend(has, n_p, names, prior, steps)


def _descend(has: list[np.ndarray], n_p: int, names: list[str], prior: float, steps: int = STEPS) -> Classifier:
    """has: the numbers of each row's features, the n_p confirmed rows first."""
    prior, n_u = min(max(prior, 1e-3), 0.999), len(has) - n_p
    row, col = np.repeat(np.arange(len(has)), [len(x) for x in has]), np.concatenate(has).astype(np.int64)
    is_p = np.arange(len(has)) < n_p
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        f = np.bincount(row, w[col], len(has)) + b
        up, down = _sigmoid(f), np.logaddexp(0, f)  # l(-f) and its slope
        negative = down[~is_p].mean() - prior * down[is_p].mean()
        d = np.where(is_p, -prior * up / n_p, up / n_u)  # of the negatives' risk
        if negative >= 0:
            d += np.where(is_p, -prior * (1 - up) / n_p, 0)
        else:
            d = -d
        g = np.append(np.bincount(col, d[row], len(names)) + L2 * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= change[:-1]
        b -= change[-1]
    return Classifier(dict(zip(names, w.tolist())), float(b))


def _draw(groups: DataFrame, share: float, salt: int) -> DataFrame:
    """groups(doc_id, of, n), each of n rows alike, to doc_id, of, times: how many of them are drawn."""
    lot = F.pmod(F.xxhash64("doc_id", "of", F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    return groups.select("doc_id", "of", F.floor(F.col("n") * F.lit(share) + lot).cast("bigint").alias("times")).where("times > 0")


class Row:
    """A text's features as their numbers in names, which all rows share."""

    def __init__(self, at: np.ndarray, names: list[str]):
        self.at, self.names = at, names

    def __iter__(self) -> Iterator[str]:
        return (self.names[i] for i in self.at)

    def __contains__(self, name: str) -> bool:
        return any(x == name for x in self)


def _sample(docs: DataFrame, few: DataFrame) -> list[tuple[int, int, Row]]:
    """p, u and features of the rows of docs that few(doc_id, of, p, u) names, each once, in an order that doesn't depend on partitions. The features are written and fetched one partition at a time; the driver keeps each distinct one once, and its number elsewhere."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "of", "p", "u")), pa.array([sorted(features(x.as_py())) for x in b.column("text")], pa.list_(pa.string()))], ["doc_id", "of", "p", "u", "features"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("of"), text.alias("text")).join(F.broadcast(few), ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])
    kind = dict(docs.dtypes)["doc_id"]
    found = materialize(rows.select("doc_id", "of", "p", "u", "text").mapInArrow(run, f"doc_id {kind}, of bigint, p bigint, u bigint, features array<string>"), "sample")
    number: dict[str, int] = {}
    names: list[str] = []
    out = []
    for r in found.toLocalIterator():
        out.append((str(r["doc_id"]), r["of"], r["p"], r["u"], Row(np.fromiter((number.setdefault(x, len(number)) for x in r["features"]), np.int32, len(r["features"])), names)))
    names.extend(number)
    return [r[2:] for r in sorted(out, key=lambda r: r[:2])]


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """docs(doc_id, text), labels(doc_id, toxic): the rows to learn from."""
    said = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    groups = docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.join(said, "doc_id", "left"), "rows")
    toxic = F.col("toxic") > 0
    n = groups.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("toxic").isNotNull(), F.col("n"))).alias("said"), F.sum(F.when(toxic, F.col("n"))).alias("toxic")).first()
    if not n["toxic"]:
        return None
    drawn: dict[tuple, list[int]] = {}
    for i, some in enumerate((_draw(groups.where(toxic), min(1.0, POSITIVES / n["toxic"]), 1), _draw(groups, min(1.0, UNLABELLED / n["rows"]), 2))):
        for r in some.collect():  # about POSITIVES or UNLABELLED rows at most
            drawn.setdefault((r["doc_id"], r["of"]), [0, 0])[i] = r["times"]
    few = docs.sparkSession.createDataFrame([(*k, *times) for k, times in drawn.items()], f"doc_id {dict(docs.dtypes)['doc_id']}, of bigint, p bigint, u bigint")
    rows = _sample(docs, few)
    positive, unlabelled = ([row for *times, row in rows for _ in range(times[i])] for i in (0, 1))
    return train(positive, unlabelled, n["toxic"] / n["said"])


def score(docs: DataFrame, model: Classifier | None, *keep: str) -> DataFrame:
    """The columns keep, score and predicted of every row of docs; kept columns of these two names come back as score_ and predicted_."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = rows.dtypes[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(x.as_py()) if model else 0.0 for x in b.column("text")]
            own = [b.column(c) for c, _ in kinds]
            yield pa.RecordBatch.from_arrays([*own, pa.array(got, pa.float64()), pa.array([int(x >= THRESHOLD) for x in got], pa.int32())], [*(c for c, _ in kinds), "score", "predicted"])

    found = rows.mapInArrow(run, ", ".join([*(f"{c} {kind}" for c, kind in kinds), "score double", "predicted int"]))
    return found.select(*[F.col(f"keep{i}").alias(f"{c}_" if c in ("score", "predicted") else c) for i, c in enumerate(keep)], "score", "predicted")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    model = fit(docs.where("not held_out"), labels)
    return score(docs, model, "doc_id", "held_out")
