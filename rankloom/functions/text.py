"""Tokens and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed list: English words that carry little meaning.
STOPWORDS = tuple(
    """
    a an and are as at be but by for from has have he her his how i in is it its
    me my no not of on or our she so than that the their them then there these they
    this to too us was we were what when where which who will with you your
    """.split()
)


_WORD = r"[\p{L}\p{N}]"
_TOKEN = rf"((?<!{_WORD})(?!(?:{'|'.join(w for w in STOPWORDS if len(w) > 1)})(?!{_WORD})){_WORD}{{2,}})"


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and numbers of any script, without stopwords and single characters: one pattern, so no token is looked at again."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN))


def tokenize_raw(text: Column) -> Column:
    """Lower-case ASCII runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))


def char_ngrams(text: Column, n: int = 4) -> Column:
    """Lower-case sequences of n characters, blanks included, in one pass."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{n}}}))"))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens, joined. tokens is read several times: give a column, not an expression."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda x, y: F.concat_ws("_", x, y))


def decimal_key(text: Column) -> Column:
    """Decimal numbers of any length as a struct that sorts as they do, equal for equal numbers: 1 and 1.00, +2 and 2, 0 and -0. Null for other texts; exponents aren't numbers here."""
    t = F.trim(text)
    whole = F.regexp_replace(F.regexp_extract(t, r"^[+-]?(\d*)", 1), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(t, r"\.(\d*)$", 1), "0+$", "")
    zero = (F.length(whole) == 0) & (F.length(part) == 0)
    negative = t.startswith("-") & ~zero
    flip = lambda c: F.translate(c, "0123456789", "9876543210")
    key = F.when(negative, F.struct((-F.length(whole) - 1).alias("size"), flip(whole).alias("whole"), F.concat(flip(part), F.lit("~")).alias("part"))).otherwise(F.struct(F.length(whole).alias("size"), whole.alias("whole"), part.alias("part")))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), key)


def rational(num: Column, den: Column) -> Column:
    """num/den in lowest terms as text, the sign on the numerator; null for a zero denominator. Euclid's steps are a fold: a pair of longs needs fewer than 92."""
    pair = F.struct(F.abs(num).cast("bigint").alias("a"), F.abs(den).cast("bigint").alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.greatest(p["b"], F.lit(1))).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["a"]
    whole = lambda x: (x.cast("decimal(19,0)") / gcd.cast("decimal(19,0)")).cast("decimal(19,0)").cast("string")
    return F.when(den != 0, F.concat(whole(num.cast("bigint") * F.signum(den).cast("bigint")), F.lit("/"), whole(F.abs(den))))


def canonical_json(columns: list[str]) -> Column:
    """A row's columns as compact JSON with sorted keys."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_id(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical JSON."""
    return F.sha2(canonical_json(columns), 256)


def digest_seed(*parts: Column) -> Column:
    """A seed from the SHA-256 of parts joined by colons, as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws(":", *parts), 256)
