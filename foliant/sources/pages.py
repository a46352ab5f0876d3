"""Page tables: cutting texts into pages and reporting on what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip

FORM_FEED = "\f"


def page_array(text: Column, lines_per_page: int | None = None) -> Column:
    """Pages of one text, by form feed or by a fixed number of lines."""
    if lines_per_page is None:
        return F.split(text, FORM_FEED)
    k = lines_per_page
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / k).cast("int"))
    return F.transform(starts, lambda p: F.array_join(F.slice(lines, p * k + 1, F.lit(k)), "\n"))


def paginate(
    docs: DataFrame, doc_id: str, text: str, lines_per_page: int | None = None
) -> DataFrame:
    """(doc_id, page_num from 1, content), one row per page; no shuffle."""
    pages = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(page_array(F.col(text), lines_per_page)).alias("_pos", "content"),
    )
    return pages.select("doc_id", (F.col("_pos") + 1).alias("page_num"), "content")


def whole_pages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every text as its own single page."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.lit(1).alias("page_num"), F.col(text).alias("content")
    )


def extraction_report(pages: DataFrame) -> DataFrame:
    """Pages and stripped characters by document; no characters at all means a scan without text."""
    return (
        pages.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.sum(F.length(strip(F.coalesce("content", F.lit(""))))).alias("n_chars"),
        )
        .withColumn("scanned", F.col("n_chars") == 0)
    )
