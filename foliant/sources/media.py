"""Listing media files without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators.timeline import media_ordinals

TASKS_PER_CORE = 4


def list_media(spark: SparkSession, folder: str, suffixes: str = "{jpg,png}") -> DataFrame:
    """(path, ordinal from 1) in path order; the file contents are never read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").load(folder).select("path")
    )
    found = found.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)  # Spark opens a task for every few files
    return media_ordinals(found).rows().select("path", "ordinal")
