"""Queries over whole tables for the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embdedup, filter_audit, langid, licenses, linededup, minhash, packing, pii, runs, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    said = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out)))
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's shingles of two words; the operator's default is five."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole records, with their blocks, dates and source headers."""
    return warc.derive(warc.responses_from_pages(_table(spark, sf_dir, "pages")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


#: Fixed values of the query's contract.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The contract's texts: a tenth of the documents, by the CRC of their ids, end in a repeated block of words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    return runs.with_repeats(docs.select("doc_id", "text"), h % 10 == 0, g, 3 + g % 8)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(with_planted_repeats(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_bpe, op2_packing, op3_langid, op4_embdedup, op5_minhash, op6_warc, op7_pii, op8_urls, op9_ann, op10_licenses,
        op11_filter_audit, op12_linededup, op13_runs,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Operators that SQL can say. The URL query's SQL holds for pages without redirect or canonical links."""
    return {
        "op6_warc": warc.oracle(), "op8_urls": urls.oracle(URL_RULES), "op10_licenses": licenses.oracle(),
        "op11_filter_audit": filter_audit.oracle(), "op12_linededup": linededup.oracle(),
    }
