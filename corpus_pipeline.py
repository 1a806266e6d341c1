"""A corpus in five stages: quality, near-duplicates, decontamination, personal data, tokens.

Each stage works on all that its predecessor kept and returns the columns of
documents; the last returns token ids.  Rows without a key pass through the
near-duplicate stage as they are; null texts count as empty and stay null until
the last stage; of rows that repeat a key one stays; columns beyond those of
documents are carried along up to the last stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import bpe, decontaminate, neardup, pii, quality
from quillstream.llm.common import read_table, stored
from quillstream.llm.queries import RANKS


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the others go."""
    return quality.keep_selected(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest key, of each group linked by five-word shingles of similarity 0.8 or more."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without stretches of benchmark items."""
    return decontaminate.remove_overlaps(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and digests of ids and decoded text."""
    encoded = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, bounds=bpe.SMALL)
    return encoded.select(
        "doc_id",
        "ids",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("tokens", tokenize),
]

#: SQL has neither the resampling models nor the tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents table, each one's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(spark, docs)
    return docs


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as Parquet in the shared checkpoint folder, read again; deleted when the application ends."""
    return stored(docs)
