"""Fill-in-middle transformation on ropes.

A text is read once, left to right, into the leaves of a balanced binary tree. A leaf holds about LEAF code points, never part of a unit, and caches how many units and code points it has; a node caches the sums of both. Two unit ranks split the tree into prefix, middle and suffix (each split walks one path and shares all other subtrees), the three subtrees are concatenated in another order with sentinel leaves between them, and the leaves in order are the output. The inverse reads an output into a tree of its own, finds the sentinels over its leaves, splits before and after them, and concatenates the subtrees in their first order; it needs nothing but output and form.

Units are code points, or the matches of a pattern, found left to right; a code point that no match covers is a unit, and empty matches count for nothing. Sentinels have to begin with a character that none of them holds elsewhere, so that none can arise where text and sentinel meet; a text that holds one stays plain.

Where to cut, and which form, comes from a digest of the seed and the id alone: the same row is cut alike on every machine and after every retry. Both directions are maps over rows in Arrow batches: nothing is shuffled, and a task holds one batch.

Defined results: a null text counts as empty, an empty text stays plain; a null id is read as an empty one. Repeated rows get the same row twice, texts with one id are cut by the same numbers, an empty table gives no rows. Columns named in keep come through as they are, under whatever names; other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import small_batches, table

LEAF, SEED = 2048, "1"
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many are transformed, and of a hundred transformed ones, how many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class Leaf:
    """Text with its counts; ends: where each unit ends, or None if each code point is one."""

    __slots__ = ("text", "chars", "units", "ends")

    def __init__(self, text: str, ends: list[int] | None = None):
        self.text, self.chars, self.ends = text, len(text), ends
        self.units = len(text) if ends is None else len(ends)

    def split(self, rank: int, units: bool) -> tuple[Leaf | None, Leaf | None]:
        if self.ends is None:
            parts = Leaf(self.text[:rank]), Leaf(self.text[rank:])
        else:
            n = rank if units else bisect_right(self.ends, rank)
            at = (self.ends[n - 1] if n else 0) if units else rank
            parts = Leaf(self.text[:at], self.ends[:n]), Leaf(self.text[at:], [e - at for e in self.ends[n:]])
        return tuple(x if x.chars else None for x in parts)


class Node:
    __slots__ = ("left", "right", "chars", "units")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.chars, self.units = left.chars + right.chars, left.units + right.units


def concat(a, b):
    """One rope of two; None is the empty rope."""
    return b if a is None else a if b is None else Node(a, b)


def split(rope, rank: int, units: bool = True):
    """The ropes before and after a rank, in units or in code points. No part is higher than the rope: on the way back up, what is left of a child takes the child's place."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= (rope.units if units else rope.chars):
        return rope, None
    if isinstance(rope, Leaf):
        return rope.split(rank, units)
    own = rope.left.units if units else rope.left.chars
    if rank <= own:
        a, b = split(rope.left, rank, units)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - own, units)
    return concat(rope.left, a), b


def leaves(rope) -> Iterator[Leaf]:
    stack = [rope] if rope is not None else []
    while stack:
        x = stack.pop()
        if isinstance(x, Leaf):
            yield x
        else:
            stack += (x.right, x.left)


def text_of(rope) -> str:
    return "".join([x.text for x in leaves(rope)])


def _pieces(text: str, unit) -> Iterator[Leaf]:
    if unit is None:
        for at in range(0, len(text), LEAF):
            yield Leaf(text[at : at + LEAF])
        return
    begin, ends, at = 0, [], 0
    matches = (m.span() for m in unit.finditer(text))
    for a, b in (*matches, (len(text), len(text))) if len(text) < LEAF else _with_end(matches, len(text)):
        for end in (*range(at + 1, a + 1), *((b,) if b > a else ())):  # what no match covers, then the match
            ends.append(end - begin)
            if end - begin >= LEAF:
                yield Leaf(text[begin:end], ends)
                begin, ends = end, []
        at = max(at, b)
    if ends:
        yield Leaf(text[begin:], ends)


def _with_end(spans, end: int):
    yield from spans
    yield end, end


def rope_of(text: str, unit: str | None = None):
    """A balanced rope of a text: neighbours are paired level by level."""
    level = list(_pieces(text, regex.compile(unit) if unit else None))
    while len(level) > 1:
        level = [concat(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else None


def find(rope, needle: str) -> int:
    """The code point where needle first begins, also across leaves, or -1."""
    tail, at = "", 0
    for x in leaves(rope):
        if (i := (tail + x.text).find(needle)) >= 0:
            return at - len(tail) + i
        at += x.chars
        tail = (tail + x.text)[-(len(needle) - 1) :] if len(needle) > 1 else ""
    return -1


def arrange(prefix, middle, suffix, form: str, sentinels=SENTINELS):
    """The rope of a form: psm, or spm with the suffix first."""
    p, s, m = map(Leaf, sentinels)
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = None
    for x in order:
        out = concat(out, x)
    return out


def invert(output: str, form: str, sentinels=SENTINELS) -> str:
    """The text that an output in a form was made of."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    rest = rope_of(output)
    parts = []
    for mark in (first, second, m):
        at = find(rest, mark)
        if at < 0:
            raise ValueError(f"no {mark} in an output of form {form}")
        before, rest = split(rest, at, False)
        _, rest = split(rest, len(mark), False)
        parts.append(before)
    _, a, b = parts
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return text_of(concat(concat(prefix, rest), suffix))


def check_sentinels(sentinels) -> tuple[str, str, str]:
    p, s, m = sentinels
    if not (p and s and m) or len({p, s, m}) < 3 or any(x[0] in y[1:] for x in sentinels for y in sentinels):
        raise ValueError("sentinels differ, and the first character of one is nowhere else in any")
    return p, s, m


def lots(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of seed, a colon and the id as text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, *keep: str, seed: str = SEED, unit: str | None = None, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, sentinels=SENTINELS) -> DataFrame:
    """docs(doc_id, text) to the columns keep and n (units), form (plain, psm or spm), prefix_units, middle_units, prefix_chars, middle_chars (null if plain), output. keep may not hold one of these names."""
    marks = check_sentinels(sentinels)
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)], *lots(F.col("doc_id"), seed), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = rows.dtypes[: len(keep)]
    out = [("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        rope = rope_of(text, unit)
        n = rope.units if rope else 0
        if not n or h3 % 100 >= transformed or any(x in text for x in marks):
            return n, "plain", None, None, None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, rest = split(rope, a)
        middle, suffix = split(rest, b - a)
        form = "spm" if h4 % 100 < suffix_first else "psm"
        chars = [x.chars if x else 0 for x in (prefix, middle)]
        return n, form, a, b - a, *chars, text_of(arrange(prefix, middle, suffix, form, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t.as_py(), *(x.as_py() for x in h)) for t, *h in zip(b.column("text"), *(b.column(f"h{i}") for i in range(1, 5)))]
            columns = zip(*found) if found else [()] * len(out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c, _ in kinds), *(pa.array(c, k) for c, (_, k) in zip(columns, out))], [*(c for c, _ in kinds), *(c for c, _ in out)])

    schema = ", ".join([*(f"{c} {kind}" for c, kind in kinds), "n bigint, form string, prefix_units bigint, middle_units bigint, prefix_chars bigint, middle_chars bigint, output string"])
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], *[c for c, _ in out])


def restore(rows: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """rows(form, output, ...) with the column restored in the place of output: the text that the output was made of, from output and form alone. Null outputs and forms have a null."""
    marks = check_sentinels(sentinels)
    small_batches(rows.sparkSession)
    own = [c for c in rows.columns if c != "output"]
    sent = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col("form").alias("form"), F.col("output").alias("output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if o is None or f is None else invert(o, f, marks) for o, f in zip(map(pa.StringScalar.as_py, b.column("output")), map(pa.StringScalar.as_py, b.column("form")))]
            yield pa.RecordBatch.from_arrays([*(b.column(f"c{i}") for i in range(len(own))), pa.array(texts, pa.string())], [*(f"c{i}" for i in range(len(own))), "restored"])

    done = sent.mapInArrow(run, ", ".join([*(f"{c} {kind}" for c, kind in sent.dtypes[: len(own)]), "restored string"]))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "restored")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = transform(table(spark, sf_dir, "documents"), "doc_id")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    back = restore(rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), "output"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", digest("restored").alias("restored_sha256"))


_LOT = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
OP11_SQL = f"""
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM (SELECT doc_id, t, length(t) AS n, {", ".join(f"{_LOT.format(8 * i + 1)} AS h{i + 1}" for i in range(4))}
    FROM (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)))
"""
