"""A corpus pipeline of five stages over ``documents``; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import bpe, decontam, quality, secrets, simhash
from keyloom.llm.common import read_table, spool

#: SQL can express neither the fitted models nor the components.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go; rows are judged one by one, repeated or not; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, null ids last.

    Rows with null or repeated ids are documents of their own; rows that repeat id and text are one.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts stay; a text counts, not its id; repeated rows stay or go together; without items all stay.
    """
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; every row stays, null and empty texts as they are."""
    return secrets.redact(docs, secrets.fit_secrets(spark))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of the ids and of the text decoded from them; a null text is empty."""
    return bpe.digest(bpe.bpe_encode(docs, bpe.vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("bpe encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = spool(docs)
    return docs
