"""A corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame that is
written and read again as the next one's documents.  All stages but the last return the columns of the
documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sandboxlake.llm import jaccard, line_dedup, mixing, packing, quality
from sandboxlake.llm.running import small_batches
from sandboxlake.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host passes."""
    return quality.quality_filter(docs)


def three_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that later occurrences of repeated windows cover."""
    return line_dedup.dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard.drop_near_duplicates(docs)


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that it takes twice is two rows."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", three_line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("target_mixing", target_mixing),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # token ids are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
