"""The named corpus queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import (
    ann,
    jaccard,
    langid,
    lm,
    manifest,
    mixing,
    packing,
    radix,
    rangejoin,
    recompression,
    secrets,
    toxicity,
    winnow,
)
from ledgerloom.session import scratch_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's raked weight and draw, half of all tokens, tempered margins."""
    return mixing.document_mix(_table(spark, folder, "documents"))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have J >= 0.9."""
    return jaccard.similar_documents(_table(spark, folder, "documents"), 3, 9, 10)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, through a fresh ledger."""
    return secrets.secret_counts(_table(spark, folder, "documents"), scratch_path(spark, "ledger"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    return langid.document_languages(_table(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_table(spark, folder, "documents"), path)


def op6_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of every document."""
    return lm.corpus_scores(_table(spark, folder, "documents"))


def op7_dimension_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every embedding whose id is divisible by 20."""
    return ann.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.document_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings with cosine >= 0.9."""
    return rangejoin.near_vectors(_table(spark, folder, "embeddings"), 0.9)


def op10_recompression(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without words of 20-word windows that also start earlier."""
    return recompression.removal_digest(_table(spark, folder, "documents"), 20)


def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    return winnow.contamination_digest(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 10)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return radix.prefix_nodes(_table(spark, folder, "conversations"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The leaf, proof and folded root of every document."""
    return manifest.manifest(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_dimension_scan": op7_dimension_scan,
    "op8_toxicity": op8_toxicity,
    "op9_range_join": op9_range_join,
    "op10_recompression": op10_recompression,
    "op11_winnowing": op11_winnowing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": mixing.oracle(),
    "op2_jaccard_join": jaccard.oracle(3, 9, 10),
    "op3_secret_scan": secrets.oracle(),
    "op9_range_join": rangejoin.oracle(0.9),
    "op10_recompression": recompression.oracle(20),
    "op11_winnowing": winnow.oracle(10),
    "op12_prefix_trie": radix.oracle(),
    "op13_merkle_manifest": manifest.oracle(),
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
