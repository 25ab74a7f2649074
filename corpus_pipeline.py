"""A corpus from raw documents to token ids, in five stages. Each takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratiolake.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from ratiolake.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not accepted go, and with them null and empty texts; rows that repeat a doc_id are judged each by itself."""
    return language_id.accepted_rows(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z in lower case, the row with the largest doc_id stays; of rows that repeat it, one. A null doc_id is smaller than any other."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the smallest doc_id stays, a null one before others; rows that repeat it all stay. Texts without words are in no group."""
    return near_dedup.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts and items hold and are held by nothing."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, their number, and digests of ids and decoded text; one row per row, null texts without ids."""
    return bpe.encode(docs, bpe.tokenizer_file(), want=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("bpe", encode_texts),
]

#: SQL can't express language identification and BPE; tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
