"""Token ids packed into rows of fixed length.

Documents are split without loss into segments of at most LENGTH tokens, and segments packed best fit decreasing: longest first, each into the row with the least room that still holds it, found in a segment tree over the room that open rows have. Each task packs groups of at least GROUP_TOKENS tokens of its own rows (a task's last group may be smaller), so nothing is shuffled and memory is bounded by a group and one document; a lost task packs the same rows again.

A packed row: ids (LENGTH little-endian 32-bit integers, PAD after the last), cu_seqlens (cumulative segment lengths, from 0), position_ids (LENGTH little-endian 16-bit integers that start anew with each segment), and doc_ids and starts, which say of which document and from which of its tokens on each segment is.

Ids come from the public tokenizer library, or from the transducer of bpe.py for texts with long runs of white space.

Defined results: null text counts as empty; a document without tokens has no segment. Rows that repeat are packed each; null ids go through. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.bpe import read_ranks, tokenizer, vocabulary
from rankloom.llm.common import small_batches, table

LENGTH, GROUP_TOKENS, PAD = 2048, 2_000_000, 0
#: From a run of so much white space on the library's pattern engine could exhaust its stack; the package's own tokenizer, which gives the same ids, reads such texts.
WIDE = re.compile(r"\s{1000}").search


class Room:
    """How many open rows have each amount of room, as a segment tree of sums."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        i = room + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The least room of at least need, and a row that has it; the row is taken out."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            self.tree[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Which lengths go together in each row."""
    room, rows = Room(length), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = room.take(lengths[i])
        if got is None:
            rows.append([i])
            left, row = length - lengths[i], len(rows) - 1
        else:
            left, row = got[0] - lengths[i], got[1]
            rows[row].append(i)
        if left:
            room.add(left, row)
    return rows


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


SCHEMA = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The packed rows of docs(doc_id, text)."""
    if not 0 < length < 1 << 16:
        raise ValueError("a row's length must fit 16 bits")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def packed(segments: list[tuple], part: int, at: int, id_type) -> pa.RecordBatch:
        lengths = [len(s[2]) for s in segments]
        out: list[list] = [[] for _ in range(8)]
        for n, members in enumerate(best_fit_decreasing(lengths, length)):
            ids, places = np.full(length, PAD, "<i4"), np.zeros(length, "<u2")
            ends = [0]
            for m in members:
                a, b = ends[-1], ends[-1] + lengths[m]
                ids[a:b] = segments[m][2]
                places[a:b] = np.arange(b - a)
                ends.append(b)
            for col, v in zip(out, (part, at + n, ends[-1], ids.tobytes(), places.tobytes(), ends, [segments[m][1] for m in members], [segments[m][0] for m in members])):
                col.append(v)
        arrays = [pa.array(c, f.type) for c, f in zip(out, SCHEMA)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(out[7], pa.list_(id_type))], [*SCHEMA.names, "doc_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        part = TaskContext.get().partitionId()
        segments, tokens, at, id_type = [], 0, 0, None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                ids = np.array(tokenizer(path, pattern).encode(text) if WIDE(text) else encode(text), "<i4")
                segments += [(doc, i, ids[i : i + length]) for i in range(0, len(ids), length)]
                tokens += len(ids)
                if tokens >= group_tokens:
                    out = packed(segments, part, at, id_type)
                    segments, tokens, at = [], 0, at + out.num_rows
                    yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))
        if segments:
            out = packed(segments, part, at, id_type)
            yield from (out.slice(i, 256) for i in range(0, out.num_rows, 256))

    return rows.mapInArrow(run, f"part int, row int, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, starts array<bigint>, doc_ids array<{kind}>")


def write(docs: DataFrame, to: str, path: str, pattern: str, length: int = LENGTH) -> None:
    """Writes packed rows as Parquet to a folder that all executors reach."""
    pack(docs, path, pattern, length).write.parquet(to)


def op4_token_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.tiktoken"))
