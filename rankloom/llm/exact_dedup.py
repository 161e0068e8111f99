"""Exact deduplication by skew-safe combining.

Equal texts are combined three times, each time by their full content and not by their digest alone: within a map task (the partial aggregate), within a salted digest group (the first shuffle; a third of all rows with one text sends at most one row from each map task to each of SALTS groups), and over the salt winners of a digest (the second shuffle).

Defined results: a null text equals an empty one. Of equal texts the largest doc_id stays; a null id is less than any other and stays only if all ids of the group are null. Rows that repeat both id and text are all marked kept by classify(); deduplicate() leaves one of them. An empty table gives no rows. Other columns, also ones named like ours, go through deduplicate() as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize, skew_join

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def text_classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows(doc_id, text, digest) to one row per distinct text: digest, text, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = rows.groupBy("digest", salt, "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _rows(docs: DataFrame, digest) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("digest", digest(F.col("text")))


def classify(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row. digest: any function of the text; texts that only share it stay apart."""
    rows = _rows(docs, digest)
    of_digest = text_classes(rows, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    of_digest = materialize(of_digest, "text-classes")
    n = of_digest.agg(F.sum("group_size")).first()[0] or 0
    ids = rows.select("doc_id", "digest")
    if of_digest.where("n_texts > 1").isEmpty():
        return skew_join(ids, of_digest.drop("n_texts"), "digest", n, "inner")
    clash = of_digest.where("n_texts > 1").select("digest")
    alone = skew_join(ids, of_digest.where("n_texts = 1").drop("n_texts"), "digest", n, "inner")
    classes = text_classes(rows.join(clash, "digest", "left_semi"), salts)
    among = rows.join(classes, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")
    return alone.unionByName(among)


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: one for each distinct text."""
    decided = classify(docs, salts=salts).where("doc_id <=> keep_id")
    decided = decided.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    decided = materialize(decided, "kept")
    own = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").alias("id_"), sha256(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest_"))
    kept = tagged.join(decided, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("digest_") == F.col("digest")), "left_semi")
    if not decided.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["id_", "digest_"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in own])


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from rankloom.llm.common import table

    return classify(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
