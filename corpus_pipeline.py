"""Corpus pipeline: language ID, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), calls one operator on every document that the stage
before it kept, and returns documents with their columns unchanged but for what the stage
decides; the last returns the pieces of the packed sequences. Further columns pass through the
stages before it, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, minhash, packing, pii
from tidemark.llm.shared import materialize


#: Rows that a Python worker holds at a time: texts are long, and workers live through all stages.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any recognisable language (``und``) go: null and empty texts, and texts without a letter.

    ``lang`` stays the source's label. Repeated rows and rows without an id are judged each by its own text."""
    _small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return docs.where(langid.language_of(F.col("text"), model)["lang_pred"] != "und")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, null ids last.

    Rows of one id and text are one document, of which any row stays. Different texts under one id, or without
    an id, are documents of their own. Null and empty texts are near no other text and stay."""
    _small_batches(spark)
    rows = minhash.numbered(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), "id", "text")
    kept = minhash.node_duplicates(rows.select("_node", "text")).where("kept").select(F.col("node").alias("_node")).distinct()
    one = rows.select("_node", "row").join(kept, "_node", "left_semi").dropDuplicates(["_node"])
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` becomes the kind's name in angle brackets; ``n_chars`` follows the text.

    The trees and their thresholds learn on all different texts that reach this stage, not on a sample.
    Null texts stay null (``n_chars`` null), empty ones empty; every row stays, repeated ones too."""
    done = pii.redact(docs, pii.fit(docs))
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens; null texts count as empty and have their end token alone.

    Repeated rows are packed each for itself, rows without an id under a null id; other columns are left behind."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: Learned models and tokenizers are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
