"""Strict readers of JSON answers, one a line, with an error code for every rule that a line breaks. All of it are column expressions: Spark's variant parser decides syntax and keys, and numbers stay text, so that they are compared exactly however many digits they have.

A line with several faults has the code of the first rule in this order: not_text (null), malformed_json, nonfinite (NaN or Infinity as a value), duplicate_key (at any depth), and then the rules of what is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"'
#: What JSON is made of besides strings.
_TOKENS = r"^(?:[\s\[\]{}:,]|(?<![\w.+-])(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])|\x01)*$"
_CONSTANT = r"(?<![\w.+-])(?:NaN|-?Infinity)(?![\w.+-])"
NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _bare(text: Column) -> Column:
    """The text with each string as one sign, so that only syntax is left."""
    return F.regexp_replace(text, _STRING, "\x01")


def json_code(text: Column) -> Column:
    """not_text, nonfinite, malformed_json, duplicate_key, or null for a sound JSON value. get_json_object accepts a key twice, and single quotes, which the tokens rule out; the variant parser refuses a key twice, so it refuses what the other accepts for that reason only."""
    bare = _bare(text)
    constant = bare.rlike(_CONSTANT)
    plain = F.regexp_replace(bare, _CONSTANT, "0")
    # beside the text, which has no letters in strings now, stands a string with one: it is the second element only if the text is one value
    parsed = plain.rlike(_TOKENS) & F.coalesce(F.get_json_object(F.concat(F.lit("["), F.regexp_replace(plain, "\x01", '""'), F.lit(',"w"]')), "$[1]") == "w", F.lit(False))
    return F.when(text.isNull(), "not_text").when(~parsed, "malformed_json").when(constant, "nonfinite").when(F.try_parse_json(text).isNull(), "duplicate_key")


def _outside(number: Column) -> Column:
    """Whether a JSON number, as text, is below zero or above one, exactly."""
    negative = number.startswith("-")
    mantissa = F.regexp_replace(F.regexp_extract(number, r"^-?([\d.]+)", 1), r"\.", "")
    digits = F.regexp_replace(mantissa, "^0+", "")
    exponent = F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1)
    size = F.regexp_replace(exponent, r"^[+-]?0*", "")
    shift = F.when(F.length(size) > 17, F.when(exponent.startswith("-"), -(10**17)).otherwise(10**17)).otherwise(F.when(size == "", F.lit(0)).otherwise(size.cast("bigint")) * F.when(exponent.startswith("-"), -1).otherwise(1))
    places = F.length(F.regexp_extract(number, r"\.(\d+)", 1)) - shift  # the value is digits over ten to the places
    one = (F.length(digits) == places + 1) & digits.rlike("^10*$")
    return (digits != "") & (negative | ~((F.length(digits) <= places) | one))


def parse_probability(lines: DataFrame, key: str = "p_positive", column: str = "value") -> DataFrame:
    """lines with code and p, the number as it was written (null if there is a code): JSON objects with one key and a number from 0 to 1. Codes beside those of json_code: not_object, keys, not_number, out_of_range."""
    text = F.col(column)
    value = F.regexp_extract(text, r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*(' + NUMBER + r")\s*\}\s*$", 1)
    kind = F.schema_of_variant(F.try_parse_json(text))
    keys = F.json_object_keys(text)
    code = F.coalesce(
        json_code(text),
        F.when(~kind.startswith("OBJECT"), "not_object").when(~F.coalesce((F.size(keys) == 1) & (keys[0] == key), F.lit(False)), "keys").when(value == "", "not_number").when(_outside(value), "out_of_range"),
    )
    return lines.withColumn("code", code).withColumn("p", F.when(F.col("code").isNull(), value))


def parse_flags(lines: DataFrame, ids: Column, column: str = "value") -> DataFrame:
    """lines with code and flags (a map of id to boolean, null if there is a code): JSON objects whose keys are the ids (an array) and whose values are true or false. Codes beside those of json_code (of which malformed_json is called invalid_json here): wrong_id_set, not_boolean."""
    text = F.col(column)
    kind = F.schema_of_variant(F.try_parse_json(text))
    keys = F.array_sort(F.json_object_keys(text))
    found = F.from_json(text, "map<string,string>")
    code = F.coalesce(
        F.when(json_code(text) == "malformed_json", "invalid_json").otherwise(json_code(text)),
        F.when(~kind.startswith("OBJECT"), "wrong_id_set").when(~F.coalesce(keys == F.array_sort(F.array_distinct(ids)), F.lit(False)), "wrong_id_set").when(~_bare(text).rlike(r"^\s*\{(?:\s*\x01\s*:\s*(?:true|false)\s*(?:,|(?=\})))*\}\s*$"), "not_boolean"),
    )
    return lines.withColumn("code", code).withColumn("flags", F.when(F.col("code").isNull(), F.transform_values(found, lambda _, v: v == "true")))


def violations(parsed: DataFrame) -> DataFrame:
    """code, n: how many lines break each rule; sound ones have the code ok."""
    return parsed.groupBy(F.coalesce("code", F.lit("ok")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
