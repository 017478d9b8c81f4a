"""A corpus pipeline of five stages over the documents.

Each stage is a function of (session, documents, table folder). All but the last return
documents with the columns they were given: quality rules keep those that pass, the n-gram join keeps
one of each group of near-duplicates, the secret scan masks what it finds, and the mix
repeats or thins out documents until sources have their target shares. Packing cuts them into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewops.llm import jaccard_join, mixing, packing, quality_rules, secrets, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    store.ship(spark)
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by a Jaccard index of 0.8 or more on five words."""
    store.ship(spark)
    return jaccard_join.distinct(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    store.ship(spark)
    names = docs.columns
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, once for every turn that takes some of it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of at most 4096 tokens."""
    store.ship(spark)
    return packing.placed(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: The rows depend on tokens, compression and hashes, which SQL doesn't have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; each result is written as Parquet and read again."""
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store.kept(stage(spark, docs, sf_dir), name)
    return docs
