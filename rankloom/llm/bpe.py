"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the encoding of its bytes exactly if each pair of neighbours stays apart under the merges, so every prefix of a piece has one encoding, which ends in one token. The machine reads a piece byte by byte. Its state has a branch for each place where a later token may still start: the bytes read since, the tokens that lead there, and which tokens may follow there. A branch ends when no token can follow. What the branches' tokens have in common is emitted, after a lookahead of a few bytes at most.

Which tokens may follow a token a is stated by its blockers: pairs of a left part y and a place among y's own merges, such that merges over the border between a and y come before y's later ones. Tokens with equal blockers are one class, and only blockers that concern the bytes read are kept. So states don't grow with the spellings met but level off: a corpus of invented words that needed 95,000 states with the tokens themselves in the key needs 26,000 with classes. States and transitions are made when they are first needed and kept; beyond STATES, also within a piece, they are dropped, which changes no result.

Pieces are the matches of the split pattern; a piece that is itself in the vocabulary is that token, as in the public library. Pieces are cached and dropped likewise.

Ranks must be those of a trained vocabulary: every byte a token, and the two parts of each token of lower rank than itself. Others raise ValueError.

Defined results: null text counts as empty and has no token; repeated rows give repeated results; an empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import small_batches, table

TOKENIZERS = "/opt/tokenizers"
#: Entries kept before a cache is dropped.
PIECES, STATES = 150_000, 100_000
NEVER = 1 << 62


def public_tokenizers(folder: str = TOKENIZERS):
    """The module that names the vocabulary files; its folder is a parameter."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    __slots__ = ("branches", "next", "end")

    def __init__(self, branches):
        self.branches = branches
        self.next: dict[int, tuple] = {}
        self.end = branches[-1][1]


class _Numbered:
    """Values and their numbers, in the order in which they are first met."""

    def __init__(self, *values):
        self.values, self.numbers = [], {}
        for v in values:
            self(v)

    def __call__(self, value) -> int:
        if (number := self.numbers.get(value)) is None:
            number = self.numbers[value] = len(self.values)
            self.values.append(value)
        return number


class Transducer:
    """Encodes pieces. A branch is (bytes read since its place, tokens that lead there, what may follow): the last is the number of a class while no byte is read, of a tuple of blockers after one, of a tuple of tokens after more (0: all may)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        if any(bytes((i,)) not in ranks for i in range(256)):
            raise ValueError("every byte must be a token")
        self._read_merges()
        self.blockers, self.followers, self.classes = _Numbered(()), _Numbered(None), _Numbered(())
        self.by_byte: list[dict[int, int]] = [{}]  # of a class: first byte of what follows, blockers
        self.class_of: dict[int, int] = {}
        self.excluded: dict[tuple, frozenset] = {}
        self.narrowed: dict[tuple, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((b"", (), 0),))

    def _state(self, branches: tuple) -> _State:
        if (s := self.states.get(branches)) is None:
            s = self.states[branches] = _State(branches)
        return s

    def _read_merges(self) -> None:
        """parts: the two tokens that a token's last merge joins. children: a token's merges as the left part. joins: the right parts that the vocabulary has for a left one. below: the tokens that begin with some bytes (two at least)."""
        ranks = self.ranks
        self.parts, self.children, self.joins, self.below, self.begins = {}, {}, {}, {}, set()
        for data, rank in sorted(ranks.items(), key=lambda r: r[1]):
            for k in range(1, len(data)):
                x, y = data[:k], data[k:]
                if x in ranks and y in ranks:
                    self.joins.setdefault(x, []).append((y, rank))
            parts = self._merge(data)
            if len(parts) != 2:
                continue  # a byte, or merges never lead to it
            if max(parts) >= rank:
                raise ValueError("a token's parts must have lower ranks than itself")
            self.parts[rank] = parts
            self.children.setdefault(parts[0], []).append(rank)
            self.begins.update(data[:k] for k in range(1, len(data)))
            for k in range(2, len(data) + 1):
                self.below.setdefault(data[:k], []).append(rank)

    def _merge(self, data: bytes) -> list[int]:
        """A token's bytes under the merges, lowest rank and leftmost first, down to two parts."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        while len(parts) > 2 and (best := min(pairs)) != NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            for i in (at - 1, at):
                if 0 <= i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return [ranks[p] for p in parts]

    def _class(self, t: int) -> int:
        """The class of a token as a left neighbour. Its right edge is a chain of parts, each there from one rank to the next; a part x that the vocabulary joins to y takes y, before y's merges of that rank or a later one."""
        if (known := self.class_of.get(t)) is not None:
            return known
        least: dict[bytes, int] = {}
        x, ends = t, NEVER
        while True:
            parts = self.parts.get(x)
            begins = x if parts else -1
            for y, rank in self.joins.get(self.token[x], ()):
                made = self.ranks[y]
                if rank < ends and (len(y) == 1 or (made in self.parts and made < ends)):
                    least[y] = min(max(rank, begins), least.get(y, NEVER))
            if not parts:
                break
            x, ends = parts[1], x
        entries = tuple(sorted((y, bisect_left(self.children.get(self.ranks[y], ()), rank)) for y, rank in least.items()))
        known = self.class_of[t] = self.classes(entries)
        if known == len(self.by_byte):
            grouped = groupby(entries, lambda e: e[0][0])
            self.by_byte.append({byte: self.blockers(tuple(some)) for byte, some in grouped})
        return known

    def _excludes(self, y: bytes, place: int, pair: bytes) -> frozenset[int]:
        """Of the tokens that begin with two bytes those that a blocker excludes: y, and what y's merges from that place on lead to."""
        if (known := self.excluded.get((y, place, pair))) is None:
            found = [t for t in self.children.get(self.ranks[y], ())[place:] if self.token[t].startswith(pair)]
            for t in found:  # grows while it is read
                found += self.children.get(t, ())
            if y.startswith(pair):
                found.append(self.ranks[y])
            known = self.excluded[y, place, pair] = frozenset(found)
        return known

    def _narrow(self, follow: int, data: bytes) -> int:
        """What may still follow, once so many bytes are read."""
        if (known := self.narrowed.get((follow, data))) is None:
            below = self.below.get(data, ())
            if len(data) == 2:
                out = set()
                for y, place in self.blockers.values[follow]:
                    if data.startswith(y) or y.startswith(data):
                        out |= self._excludes(y, place, data)
                left = tuple([t for t in below if t not in out])
            else:
                left = tuple([t for t in self.followers.values[follow] if self.token[t].startswith(data)])
            known = self.narrowed[follow, data] = self.followers(left if len(left) < len(below) else None)
        return known

    def _step(self, s: _State, byte: int) -> tuple:
        found, branches = None, []
        for data, chain, follow in s.branches:
            data += bytes((byte,))
            t, more = self.ranks.get(data), data in self.begins
            if len(data) == 1:
                follow = self.by_byte[follow].get(byte, 0)
                blockers = self.blockers.values[follow]
                fits = not blockers or blockers[0][0] != data
            else:
                if follow:
                    follow = self._narrow(follow, data)
                if follow:
                    rest = self.followers.values[follow]
                    fits = t in rest
                    more = len(rest) > fits
                else:
                    fits = t in self.parts
            if fits and found is None:
                found = (*chain, t)
            if more:
                branches.append((data, chain, follow))
        branches.append((b"", found, self._class(found[-1])))
        chains = [b[1] for b in branches]
        common = next((i for i, tokens in enumerate(zip(*chains)) if len(set(tokens)) > 1), min(map(len, chains)))
        if len(self.states) >= STATES:
            self.reset()
        to = self._state(tuple([(data, chain[common:], follow) for data, chain, follow in branches]))
        s.next[byte] = got = (found[:common], to)
        return got

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        s, out = self.start, []
        for byte in piece:
            got = s.next.get(byte)
            emitted, s = got if got is not None else self._step(s, byte)
            if emitted:
                out += emitted
        out += s.end
        return out


class Utf8Stream:
    """Incremental UTF-8: its state is the bytes of a character not yet whole. Bytes that can't be part of one become U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte >= 0xC0:  # a lead: how many bytes does it ask for?
                    cut -= back if back < (4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2) else 0
                    break
                if byte < 0x80:
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Tokenizer:
    """Texts to ids and back."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        size = max(self.machine.token) + 1
        self.bytes_of = [self.machine.token.get(i, b"") for i in range(size)]

    def _piece(self, piece: str) -> bytes:
        if len(self.cache) >= PIECES:
            self.cache.clear()
        ids = struct.pack(f"<{len(ids := self.machine.encode(piece.encode('utf-8')))}I", *ids)
        if len(piece) <= 64:
            self.cache[piece] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self.cache.get, self._piece
        return b"".join([known(p) or piece(p) for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], every: int = 4096) -> Iterator[str]:
        """Text as ids come in; characters may span tokens."""
        stream, ids = Utf8Stream(), iter(ids)
        while some := list(islice(ids, every)):
            yield stream.feed(self.decode_bytes(some))
        yield stream.feed(b"", final=True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python worker, kept over tasks."""
    return Tokenizer(path, pattern)


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZERS) -> tuple[str, str]:
    """The rank file's path and the split pattern."""
    module = public_tokenizers(folder)
    return module.path(name), module.PATTERN


def digest_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded bytes, and if asked for the ids, of every row of docs(doc_id, text). Documents are encoded, and decoded again from their ids."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for b in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for x in b.column("text"):
                data = own.encode_bytes(x.as_py())
                ids = np.frombuffer(data, "<u4")
                decoded = hashlib.sha256()
                for part in own.decode_stream(ids.tolist()):
                    decoded.update(part.encode("utf-8"))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(decoded.hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, f"doc_id {kind}, {kinds}")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), *vocabulary())
