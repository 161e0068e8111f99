"""A corpus pipeline of five operators. Each stage works on all rows that the one before it kept, as read back from Parquet.

Edge cases, for every stage: null texts count as empty (the first stage rejects both), null ids are kept as ids that equal each other, rows with one id and unlike texts are judged apart, texts are read whole, extra columns go through up to the last stage whatever their names, and an empty table gives no rows.

STAGES: language ID (texts without letters go), exact deduplication (of equal texts the largest doc_id stays), SimHash near-deduplication (of each component the smallest doc_id stays), benchmark decontamination (documents that contain an item go), byte-level BPE (documents become token ids). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bpe, decontam, exact_dedup, langid, simhash
from rankloom.llm.common import materialize, table


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that op7 learns from, and rejects what it finds undetermined: null texts and those without a letter. A low score alone rejects nothing, as short and mixed texts are clean. Where nothing can be learned all texts with letters stay."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col("text"))
    found = langid.predict(rows, model, "row_").where(F.col("lang_pred") != "und") if model else rows.where(F.col("text").rlike(r"\p{L}"))
    return found.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; null is less than any id, and of rows that repeat both one stays."""
    return exact_dedup.deduplicate(docs)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of operator 10's links the row with the smallest id stays, null ids last; of rows that share the id the text with the smallest SHA-256."""
    return simhash.near_deduplicate(docs)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain an item of the benchmark go; an empty benchmark drops nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every row."""
    return bpe.digest_documents(docs, *bpe.vocabulary(), with_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_dedup", near), ("decontamination", decontaminate), ("byte_bpe", encode)]

#: Language ID and SimHash components have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
