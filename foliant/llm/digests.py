"""Exact deduplication against a persistent index of digests.

The index is a Parquet table bucketed and sorted by digest. A new batch is reduced to one row per digest before
anything is shuffled, meets the index in a sort-merge anti-join for which the index is not moved, and what is new is
appended. Only DataFrame functions are used; texts leave the scan as 32-byte digests and are never shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import LOWER, UPPER, fold_ascii, picked, query
from foliant.plans.sizing import lookup_join, scratch_path, written

COLUMNS = "digest BINARY, keep_id BIGINT, n BIGINT, batch STRING"


@dataclass(frozen=True)
class DigestIndex:
    """Where an index lies and in how many buckets."""

    spark: SparkSession
    path: str
    buckets: int

    def _named(self) -> str:
        """Name of the table in this session's catalog; the files carry the data, the name only the layout."""
        name = f"foliant_digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return name

    def rows(self) -> DataFrame:
        """The index as a bucketed table."""
        name = self._named()
        self.spark.sql(f"REFRESH TABLE {name}")
        return self.spark.table(name)

    def files(self) -> DataFrame:
        """The same rows without the bucket layout: both sides of a join are then shuffled, and AQE can split hot digests."""
        return self.spark.read.schema(COLUMNS).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Add rows; each task writes one bucket, sorted."""
        (
            rows.select("digest", "keep_id", "n", "batch")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self._named())
        )

    def forget(self) -> None:
        """Take the name out of the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._named()}")


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
    """An index at ``path``, made there when it is first written. ``buckets`` must not change during its life."""
    return DigestIndex(spark, path.rstrip("/"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text after lower-casing A-Z, null as empty."""
    slim = picked(docs, doc_id=id_col, text=text_col)
    return slim.select("doc_id", F.unhex(F.sha2(fold_ascii(F.col("text")).cast("binary"), 256)).alias("digest"))


def add_batch(index: DigestIndex, digests: DataFrame, batch: str) -> DataFrame:
    """Append the digests of a batch that the index does not hold yet and return what was appended.

    A batch that died half-way may be added again under its name: its own rows do not count as known, and are not
    appended twice.
    """
    largest = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    known = index.rows().select("digest")
    new = written(largest.hint("merge").join(known, "digest", "left_anti"), "new-digests")
    index.append(new.withColumn("batch", F.lit(batch)))
    return index.files().where(F.col("batch") == batch)


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: DigestIndex | None = None,
    batch: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after lower-casing A-Z; null counts as empty. Of the equal texts of a batch the
    largest doc_id stays, unless the index already holds the text: then no document of the batch stays and keep_id is
    the one the index holds. group_size is the number of rows of the batch in which the kept text came first. Rows that
    repeat a doc_id with the same text are one document and share its fate. A row without id stays only if no equal
    text has one. An empty table gives no rows and leaves the index as it is.
    """
    spark = docs.sparkSession
    throwaway = index is None
    index = index or open_index(spark, scratch_path(spark, "digest-index"))
    digests = written(digested(docs, id_col, text_col), "digests")
    add_batch(index, digests, batch or uuid.uuid4().hex)
    holds = index.files().select("digest", "keep_id", F.col("n").alias("group_size"))
    if throwaway:
        index.forget()
    return digests.join(holds, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _row_key(doc_id: Column, digest: Column) -> Column:
    """One value for an id, which may be null, and a digest."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).cast("binary"))


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows that ``exact_duplicates`` keeps, one for each text.

    Null texts count as empty, rows without id stay only where no equal text has one, and a row that is repeated whole, or with
    other values in other columns, stays once. Columns of any name may be there. Whole rows are filtered by the keys that go,
    which are broadcast if they are checked to be few and joined otherwise; only rows whose own key is repeated are grouped.
    """
    found = exact_duplicates(docs, id_col, text_col).select(_row_key(F.col("doc_id"), F.unhex("text_sha256")).alias("key"), "kept")
    keys = written(found.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "row-keys")
    digest = F.unhex(F.sha2(fold_ascii(F.col(f"`{text_col}`")).cast("binary"), 256))
    rows = docs.select(_row_key(F.col(f"`{id_col}`"), digest).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = lookup_join(rows, keys.where("NOT kept OR n > 1").select("key"), ["key"], "left_anti", spread_by=["key"])
    repeated = keys.where("kept AND n > 1").select("key")
    once = lookup_join(rows, repeated, ["key"], "left_semi", spread_by=["key"]).groupBy("key").agg(F.first("row").alias("row"))
    return kept.unionByName(once).select(*[F.col(f"row.`{c}`") for c in docs.columns])


OP4_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


@query("op4_exact_dedup", OP4_SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
