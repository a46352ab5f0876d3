"""What the two finders of repeated passages share: rows of texts, joins back to them, and space given back early."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.base import picked
from foliant.plans.sizing import written

if TYPE_CHECKING:
    import pyarrow as pa

CHUNK = 2 << 20  # bytes of text that are worked on together


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text): null texts are empty; id and tag, a digest of the text, tell rows apart.

    Rows that repeat both id and text are treated alike, so one key for them does no harm.
    """
    slim = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return slim.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def same_row(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id <=> {b}.doc_id AND {a}.tag = {b}.tag")


def with_lists(texts: DataFrame, items: DataFrame, column: str, how: str) -> DataFrame:
    """The rows of ``texts`` with the list of their ``items`` (a column of whole numbers); a list is bounded by its text."""
    lists = items.groupBy("doc_id", "tag").agg(F.collect_list(column).alias("found"))
    return texts.alias("t").join(lists.alias("l"), same_row("t", "l"), how).select("t.doc_id", "t.tag", "t.text", "l.found")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes], pa.RecordBatch]]:
    """Rows of each batch in stretches of about ``CHUNK`` bytes of text: row numbers, texts, batch."""
    import pyarrow as pa

    for batch in batches:
        rows: list[int] = []
        texts: list[bytes] = []
        size = 0
        for i, value in enumerate(batch.column("text").cast(pa.binary())):
            text = value.as_py()
            rows.append(i)
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield rows, texts, batch
                rows, texts, size = [], [], 0
        if rows:
            yield rows, texts, batch


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder, and give back the disk of the shuffles that went into it.

    Spark removes shuffle files once the driver has collected the plans that refer to them. A long job would keep the
    files of all its steps until the driver happens to collect garbage, so it is asked to do so here.
    """
    done = written(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of scratch tables that are not read any more."""
    conf = spark._jsc.hadoopConfiguration()
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
