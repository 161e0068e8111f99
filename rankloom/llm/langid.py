"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Every byte of a text gets label probabilities; a document's are the mean of their logarithms over its bytes, made to sum to one. Texts are read whole, as windows of WINDOW bytes that the network reads independently in both directions, many windows at once, so memory is bounded by the window and not by the text.

Training takes a bounded sample (SAMPLE_DOCS labelled documents, at most so many of each label, chosen by a hash of id and text; of longer ones a piece of PIECE characters) and draws windows from anywhere in them; it runs once on the driver and its weights, some kilobytes, go to the workers. Labels and ids are never inputs of a prediction.

Defined results: null text, or one without a letter, is `und` with score 1; if nothing can be learned (no labelled row) every text is `und` with score 0. Ties of labels go to the first in alphabetical order. Repeated rows get the same row twice; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import fold, small_batches, table

HIDDEN, WINDOW, ROWS = 8, 96, 1024
SAMPLE_DOCS, PIECE, STEPS, BATCH, RATE, SEED = 2000, 4096, 500, 128, 0.02, 7
LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Bytes as rows of a matrix, 256 where a text has ended."""
    out = np.full(-(-len(data) // size) * size, 256, np.int16)
    out[: len(data)] = data
    return out.reshape(-1, size)


def _init(labels: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"E{d}"] = rng.normal(0, 0.3, (257, 3 * hidden))  # inputs of the update gate, the reset gate and the candidate
        p[f"U{d}"] = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))
        p[f"V{d}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
    p["W"], p["c"] = rng.normal(0, 0.3, (2 * hidden, labels)), np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _run(E, U, V, x: np.ndarray, keep: bool = False):
    """States after each byte of x (rows, time), and what backpropagation needs."""
    n, t_max = x.shape
    h_n = V.shape[0]
    h = np.zeros((n, h_n), np.float32)
    out = np.empty((t_max, n, h_n), np.float32)
    saved = []
    for t in range(t_max):
        a = E[x[:, t]]
        g = _sigmoid(a[:, : 2 * h_n] + h @ U)
        z, r = g[:, :h_n], g[:, h_n:]
        rh = r * h
        c = np.tanh(a[:, 2 * h_n :] + rh @ V)
        if keep:
            saved.append((h, g, rh, c))
        h = h + z * (c - h)
        out[t] = h
    return (out, saved) if keep else out


def _back(E, U, V, x: np.ndarray, saved, d_out: np.ndarray):
    """Gradients through time."""
    h_n = V.shape[0]
    gE, gU, gV = np.zeros_like(E), np.zeros_like(U), np.zeros_like(V)
    dh = np.zeros_like(d_out[0])
    for t in range(len(saved) - 1, -1, -1):
        h, g, rh, c = saved[t]
        z, r = g[:, :h_n], g[:, h_n:]
        dh = dh + d_out[t]
        dc = dh * z * (1 - c * c)
        drh = dc @ V.T
        dg = np.concatenate([dh * (c - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
        gU += h.T @ dg
        gV += rh.T @ dc
        np.add.at(gE, x[:, t], np.concatenate([dg, dc], axis=1))
        dh = dh * (1 - z) + drh * r + dg @ U.T
    return gE, gU, gV


class Model:
    def __init__(self, labels: list[str], weights: dict[str, np.ndarray]):
        self.labels, self.weights = labels, weights

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities (time, rows, labels) of every byte of windows x."""
        w = self.weights
        ahead = _run(w["Ef"], w["Uf"], w["Vf"], x)
        behind = _run(w["Eb"], w["Ub"], w["Vb"], x[:, ::-1])[::-1]
        h_n = ahead.shape[2]
        logits = ahead @ w["W"][:h_n] + behind @ w["W"][h_n:] + w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities of each text."""
        total = np.zeros((len(texts), len(self.labels)))
        sizes = np.array([max(1, len(t)) for t in texts])
        parts = [windows(np.frombuffer(t, np.uint8)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        full = np.concatenate(parts) if parts else np.empty((0, WINDOW), np.int16)
        for at in range(0, len(full), ROWS):
            x = full[at : at + ROWS]
            logs = self.positions(x) * (x.T != 256)[:, :, None]
            np.add.at(total, owner[at : at + ROWS], logs.sum(axis=0, dtype=np.float64))
        total /= sizes[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Model | None:
    """Adam on the mean cross entropy of every byte of windows drawn from anywhere in the texts, each label as often."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    by = [[t for t, x in zip(texts, labels) if x == name and t] for name in names]
    by = [b or [b" "] for b in by]
    w = _init(len(names), hidden, rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(len(names), size=BATCH)
        x = np.full((BATCH, WINDOW), 256, np.int16)
        for i, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = int(rng.integers(max(1, len(t) - WINDOW + 1)))
            part = np.frombuffer(t[at : at + WINDOW], np.uint8)
            x[i, : len(part)] = part
        back = np.ascontiguousarray(x[:, ::-1])
        ahead, saved_f = _run(w["Ef"], w["Uf"], w["Vf"], x, True)
        behind, saved_b = _run(w["Eb"], w["Ub"], w["Vb"], back, True)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        logits = both @ w["W"] + w["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        p *= (x.T != 256)[:, :, None] / max(1, int((x != 256).sum()))
        d = p @ w["W"].T
        g = {"W": np.einsum("tnh,tnk->hk", both, p), "c": p.sum(axis=(0, 1))}
        g["Ef"], g["Uf"], g["Vf"] = _back(w["Ef"], w["Uf"], w["Vf"], x, saved_f, d[:, :, :hidden])
        g["Eb"], g["Ub"], g["Vb"] = _back(w["Eb"], w["Ub"], w["Vb"], back, saved_b, d[::-1, :, hidden:])
        norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in w:
            gk = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (gk - m[k])
            v[k] += 0.01 * (gk * gk - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, w)


def fit(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, piece: int = PIECE) -> Model | None:
    """rows(doc_id, text, lang): trains on a bounded sample, about the same number of rows of each label as far as there are, chosen by a hash of id and text, so that a text on many rows neither vanishes nor floods it. Of a longer text a piece of so many characters from a place that a hash gives is read: the sample is bounded in bytes too."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = -(-sample_docs // len(counts))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * each / n))) for k, n in counts.items()])
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0
    part = F.when(F.length("text") <= piece, F.col("text")).otherwise(F.expr(f"substring(text, 1 + cast(pmod(xxhash64(text, 1), length(text) - {piece}) as int), {piece})"))
    got = rows.where(lot < share).select("lang", part.alias("text"), F.xxhash64("doc_id", "text").alias("order")).collect()  # about 1.5 times the sample
    got.sort(key=lambda r: (r["lang"], r["order"], r["text"]))
    texts, labels, had = [], [], {}
    for r in got:
        had[r["lang"]] = had.get(r["lang"], 0) + 1
        if had[r["lang"]] <= each:
            texts.append(r["text"].encode("utf-8"))
            labels.append(r["lang"])
    return train(texts, labels)


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns keep, and lang_pred and score of every row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text_"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text_").to_pylist()
            read = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            labels, scores = ["und"] * len(texts), [1.0] * len(texts)
            if model is None:
                scores = [0.0 if i in set(read) else 1.0 for i in range(len(texts))]
            elif read:
                p = model.documents([texts[i].encode("utf-8") for i in read])
                for i, best, top in zip(read, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    labels[i], scores[i] = model.labels[best], float(top)
            own = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("not held_out"))
    return predict(docs, model, "doc_id", "held_out")
