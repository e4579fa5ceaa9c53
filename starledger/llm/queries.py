"""The operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import credentials, decontam, langid, linededup, minhash, mixing, repetition, simhash, sitetemplate, structure, token_records, toxicity, whitening
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.written(table(spark, sf_dir, "documents"), spark)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetemplate.extract(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.report(table(spark, sf_dir, "conversations"))


OPERATORS = (
    op1_decontamination,
    op2_toxicity,
    op3_line_dedup,
    op4_token_records,
    op5_language_id,
    op6_source_mixing,
    op7_site_templates,
    op8_secrets,
    op9_repetition,
    op10_simhash,
    op11_whitening,
    op12_minhash_forest,
    op13_structure_repair,
)
QUERIES = {f.__name__: f for f in OPERATORS}
#: Trained models, token ids, 64-bit string hashes and html have no SQL form; tests hold them against brute force.
ORACLES = {"op1_decontamination": decontam.ORACLE, "op3_line_dedup": linededup.ORACLE, "op6_source_mixing": mixing.ORACLE, "op9_repetition": repetition.ORACLE}
