"""Corpus preparation: language, near-duplicates, benchmark leaks, mixture, token records.

Each stage works on everything its predecessor kept. All but the last return the columns of
``documents``, whatever they are called, unchanged; the last returns one row for each document of
the mixture, read back from the token records: doc_id, start, n_tokens, ids_crc32. Texts are
used whole at any length; an empty table goes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starledger.llm import decontam, langid, mixing, simhash, token_records
from starledger.llm.common import scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letter (null and empty texts), or too unsure. Repeated rows go or stay alike."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays, the one of least doc_id.

    Null and empty texts are one component; of repeated rows one stays; rows without an id stay
    where their component has none, the one with the least hash of the text.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; without items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that all sources weigh the same, then shuffled.

    A null source is a source of its own; rows of one doc_id are repeated alike.
    """
    return mixing.mix(docs, numbered=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in ascending doc_id order, null ids first; a repeated document is repeated there, a null text is the end id alone."""
    return token_records.written(docs, spark)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixture), ("token-ID / binary output", tokens)]

#: The language model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark, "stage")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
