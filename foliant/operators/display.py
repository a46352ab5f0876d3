"""Presenting hits: highlighting, rounding and joined snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remap_marks(c: Column, old: tuple[str, str], new: tuple[str, str]) -> Column:
    """Exchange the marker pair around hits; brackets of the text itself are escaped."""
    opened, closed = new
    out = F.replace(F.replace(c, F.lit(old[0]), F.lit(opened)), F.lit(old[1]), F.lit(closed))
    if not opened.startswith("["):
        return out
    out = F.replace(out, F.lit("["), F.lit("\\["))
    stem = opened.split(" ")[0].rstrip("]")
    return F.replace(out, F.lit("\\" + stem), F.lit(stem))


def rank_display(hits: DataFrame, places: int = 2) -> DataFrame:
    """Match number from 1 and the score rounded for reading."""
    return hits.select(
        "query_id", "doc_id", "page_num",
        F.col("rank_no").alias("match_no"),
        F.bround("score", places).alias("shown_score"),
    )


def join_snippets(results: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Snippets of each query in result order as one context text.

    ``results`` holds the returned rows of each query (a limit of a few), never whole groups.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    lines = F.transform(rows, lambda r: F.concat(F.lit("Snippet: "), r[text]))
    return results.groupBy(*by).agg(F.array_join(lines, "\n").alias("context"))
