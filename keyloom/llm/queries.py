"""Queries of the text operators over whole tables, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, decontam, langid, quality, secrets, sharding, simhash, spans, suffixes, toxicity
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_languages(docs))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.bpe_encode(read_table(spark, sf_dir, "documents"), bpe.vocabulary()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spans.dedup_spans(read_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_removed", F.size("spans").alias("n_spans"),
        F.length("kept").alias("n_chars_kept"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"), secrets.fit_secrets(spark))
    return found.select(
        "doc_id", "word_ix", F.length("secret").alias("n_chars"), F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"),
        "score", "is_secret",
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup_bytes(read_table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s.stop - s.start)
    return cut.select(
        "doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.balance(read_table(spark, sf_dir, "documents"))
    return put.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def queries() -> dict:
    """Name and function of each query."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express: none, each fits a model or compares all texts."""
    return {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
