"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.plans.sizing import app_dir
from foliant.sources.index import Index, open_or_build_index
from foliant.sources.pages import whole_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers of the session, once."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/foliant", "zip", root, "foliant")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_pages(table(spark, sf_dir, "documents"), "doc_id", "text")


def derived_path(spark: SparkSession, sf_dir: str, label: str) -> str:
    """Where this application keeps tables derived from a data folder."""
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    return f"{app_dir(spark)}/{label}-{tag}"


def search_index(spark: SparkSession, sf_dir: str) -> Index:
    """Index of the documents: built by the first query that needs it, then read."""
    return open_or_build_index(spark, derived_path(spark, sf_dir, "index"), corpus(spark, sf_dir))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, w): the words of each benchmark passage; queries are made of them."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("w"))


# SQL for the same tokens, postings and query words.
def words_sql(column: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(strip_accents(lower({column})), "
        r"'[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '')"
    )


TOKENS_SQL = f"tok AS (SELECT doc_id, {words_sql('text')} AS toks FROM documents)"
POSTINGS_SQL = (
    TOKENS_SQL
    + """,
pos AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS p, len(toks) AS dl FROM tok),
post AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM pos GROUP BY term, doc_id),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term),
stats AS (SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS total_tokens, avg(len(toks)) AS avgdl FROM tok)"""
)
QUERIES_SQL = f"q AS (SELECT item_id AS query_id, {words_sql('text')} AS w FROM benchmark)"


def idf_sql(df: str) -> str:
    raw = f"ln((n_docs - {df} + 0.5) / ({df} + 0.5))"
    return f"CASE WHEN {raw} <= 0 THEN 1e-6 ELSE {raw} END"


def bm25_sql(df: str) -> str:
    return f"-(({idf_sql(df)}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))"
