"""Exact histogram of encoded lengths.

Documents are encoded once, in the scan's tasks; one row per length and task is shuffled. Suffix sums over the
histogram then answer, for every context limit at once, how many documents and tokens fit, are cut or are lost.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import picked, query

if TYPE_CHECKING:
    import pyarrow as pa

RANKS = "byte_bpe_50k.tiktoken"
STRETCH = 1 << 12  # lengths whose suffix sums are made in one group


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encode = _encoder(path).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if (t := v.as_py()) else 0 for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "tokens"])

    return count


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of each whole text; null and empty texts have 0 tokens."""
    slim = picked(docs, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_counting(path or vocabulary(RANKS)), f"doc_id {kind}, tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with suffix sums.

    tokens, n_docs: the length and the documents of just that length; docs_from and tokens_from: documents at least as
    long, and their tokens; docs_below and tokens_below: the others; total_docs and total_tokens: all; kept_at_limit:
    tokens left if every document is cut to this length; quantile: share of documents not longer than it. An empty
    table gives no rows.
    """
    counts = lengths.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.withColumn("stretch", F.floor(F.col("tokens") / STRETCH))
    mass = F.col("n_docs") * F.col("tokens")
    # Two levels, so that no task sorts all lengths: sums inside a stretch, and one row per stretch for what lies above.
    inside = Window.partitionBy("stretch").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, 0)
    per_stretch = counts.groupBy("stretch").agg(F.sum("n_docs").alias("d"), F.sum(mass).alias("t"))
    above = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    offsets = per_stretch.select(
        "stretch",
        F.coalesce(F.sum("d").over(above), zero).alias("d_above"),
        F.coalesce(F.sum("t").over(above), zero).alias("t_above"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    summed = counts.select(
        "*", F.sum("n_docs").over(inside).alias("d_in"), F.sum(mass).over(inside).alias("t_in")
    ).join(offsets, "stretch")
    docs_from = F.col("d_in") + F.col("d_above")
    tokens_from = F.col("t_in") + F.col("t_above")
    below = F.col("total_docs") - docs_from
    return summed.select(
        "tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        below.alias("docs_below"),
        (F.col("total_tokens") - tokens_from).alias("tokens_below"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("tokens")).alias("kept_at_limit"),
        ((below + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, documents that are cut, tokens kept and tokens lost."""
    fits = F.col("tokens") <= F.col("context_limit")
    n = F.col("n_docs")
    kept = n * F.least("tokens", "context_limit")
    return (
        histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])))
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(fits, n).otherwise(0)).alias("docs_fit"),
            F.sum(F.when(fits, 0).otherwise(n)).alias("docs_cut"),
            F.sum(kept).alias("tokens_kept"),
            F.sum(n * F.col("tokens") - kept).alias("tokens_lost"),
        )
    )


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share: the smallest length that at least this share of the documents does not exceed."""
    found = [
        F.min(F.when(F.col("quantile") >= share, F.col("tokens"))).alias(f"q{i}") for i, share in enumerate(shares)
    ]
    picks = F.explode(
        F.array(*[F.struct(F.lit(s).cast("double").alias("share"), F.col(f"q{i}").alias("tokens")) for i, s in enumerate(shares)])
    )
    return histogram.agg(*found).select(picks.alias("p")).select("p.share", "p.tokens")


@query("op1_token_lengths")
def op1_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
