"""The corpus queries over the driver tables; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, capfilters, decontaminate, exacthash, importance, lmscore, maintext, pii, quality, secrets, simhash, tokencount, trie
from .common import read_table

#: Rank file, pattern and model that the queries use; the operators take any.
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    encoded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digests(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.extract(read_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold stretches of benchmark items."""
    return decontaminate.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digests(pii.find_personal(read_table(spark, sf_dir, "documents")))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the embeddings."""
    return capfilters.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and network scores of every document."""
    return lmscore.score(read_table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among the documents."""
    return exacthash.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document, towards the benchmark."""
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations."""
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secrets": op3_secrets,
    "op4_main_text": op4_main_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_personal": op8_personal,
    "op9_cap_filters": op9_cap_filters,
    "op10_lm_score": op10_lm_score,
    "op11_exact": op11_exact,
    "op12_importance": op12_importance,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Only where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE,
    "op11_exact": exacthash.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
