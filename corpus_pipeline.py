"""From raw documents to packed training sequences: five stages, each an operator of ``foliant.llm``.

Every stage works on all rows that its predecessor kept; its result is written as Parquet and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.catalog.base import ship, table
from foliant.llm.contamination import without_contaminated
from foliant.llm.digests import without_exact_duplicates
from foliant.llm.neardup import without_near_duplicates
from foliant.llm.packing import pack_documents, piece_digests
from foliant.llm.repeats import settle
from foliant.llm.toxicity import fit, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity 1 or more go; the model is fitted on the labels of the documents at hand."""
    ship(spark)
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 percent of their shingles of five words, the smallest doc_id stays."""
    ship(spark)
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    ship(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    ship(spark)
    return piece_digests(pack_documents(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A fitted classifier and a tokenizer are not SQL; tests/llm holds the pipeline against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
