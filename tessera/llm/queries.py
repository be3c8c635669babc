"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, debruijn, exact_dedup, language_id, line_dedup, mixing, segment_sampling, simhash, suffix_dedup, token_counts
from .common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest_neighbours(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(documents(spark, sf_dir), digest=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, and decoding of what it gives: decoded_sha256 is the digest of the text, null as empty."""
    return segment_sampling.encode_samples(documents(spark, sf_dir), decoded=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup_substrings(documents(spark, sf_dir), digest=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op9_substring_dedup": debruijn.ORACLE,
}
