"""Keyed tables kept as Parquet: each change is a DataFrame of the table's next state.

Key lookups go through ``lookup_join``, so a change set is broadcast only if it is checked to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.ordered import ordered
from foliant.plans.sizing import lookup_join, written


def ensure_table(spark: SparkSession, name: str, ddl: str, path: str | None = None) -> None:
    at = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{at}")


def truncate(spark: SparkSession, name: str) -> None:
    empty = spark.createDataFrame([], spark.table(name).schema)
    empty.write.insertInto(name, overwrite=True)


def list_titles(table: DataFrame, key: str, title: str) -> DataFrame:
    return table.select(F.col(key).alias("id"), F.col(title).alias("title")).orderBy("id")


def list_keys(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return table.select(key, *columns).orderBy(key)


def newest_first(table: DataFrame, created: str, key: str) -> DataFrame:
    return table.orderBy(F.desc(created), key)


def limit_n(table: DataFrame, order: list[str], n: int) -> DataFrame:
    return table.orderBy(*order).limit(n)


def insert_rows(
    table: DataFrame, key: str, rows: DataFrame, order: list[str], created: str, now: Column
) -> DataFrame:
    """Append rows under new ids that continue after the largest one, in the given order."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).scalar()
    numbered = ordered(rows, [], order).number("_no").rows()
    fresh = numbered.withColumn(key, last + F.col("_no")).drop("_no")
    stamp = F.coalesce(F.col(created), now) if created in rows.columns else now
    return table.unionByName(fresh.withColumn(created, stamp).select(*table.columns))


def _known(table: DataFrame, key: str, batch: DataFrame) -> DataFrame:
    """The keys of a batch that stand in the table; the table is only filtered by them, never shuffled as a whole."""
    asked = batch.select(key).where(F.col(key).isNotNull()).distinct()
    return lookup_join(table.select(key), asked, [key], "left_semi", bounded_by=batch).distinct()


def insert_if_absent(table: DataFrame, key: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add the rows whose key is not there yet, of rows with one key the first in ``order`` (all columns by default).

    A null key equals no other, so all its rows are added.
    """
    names = [c for c in rows.columns if c != key]
    rank = F.struct(*(order or names))
    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*names), rank).alias("_row"))
    firsts = once.select(key, "_row.*").select(*rows.columns)
    fresh = lookup_join(firsts, _known(table, key, rows), [key], "left_anti", bounded_by=rows)
    added = fresh.select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))
    return table.unionByName(added.select(*table.columns))


def insert_unique(
    table: DataFrame, key: str, batch: DataFrame, order: str
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a key may be new only once, the first row of the batch wins, of equal ones just one.

    A null key equals no other and is always accepted.
    """
    rows = written(batch.withColumn("_row", F.monotonically_increasing_id()), "batch")
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, "_row")).alias("_first"))
    winners = lookup_join(firsts, _known(table, key, batch), [key], "left_anti", bounded_by=batch)
    marked = lookup_join(rows, winners, [key], "left", bounded_by=batch)
    wins = F.col(key).isNull() | F.coalesce(F.col("_row") == F.col("_first")["_row"], F.lit(False))
    return marked.where(wins).select(*batch.columns), marked.where(~wins).select(*batch.columns)


def update_by_id(table: DataFrame, key: str, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Replace the columns that ``changes`` has, where the id matches; NULL is a value like others.

    Of several changes with one id the last in ``order`` counts, by default the largest by all its columns.
    """
    names = [c for c in changes.columns if c != key and c in table.columns]
    rank = F.struct(*(order or names))
    packed = changes.groupBy(key).agg(F.max_by(F.struct(*names), rank).alias("_new"))
    joined = lookup_join(table, packed, [key], "left", bounded_by=changes)
    cols = [
        F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        if c in names
        else F.col(c)
        for c in table.columns
    ]
    return joined.select(*cols)


def delete_by_key(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return lookup_join(table, gone.select(key).distinct(), [key], "left_anti", bounded_by=gone)


def affected_rows(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows a delete would take, by requested key; "not found" where there are none."""
    asked = gone.select(key).distinct()
    counts = (
        lookup_join(table, asked, [key], "left_semi", bounded_by=gone)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0))
    joined = lookup_join(asked, counts, [key], "left", spread_by=[key], bounded_by=gone)
    return joined.select(
        key, n.alias("n_deleted"), F.when(n == 0, "not found").otherwise("deleted").alias("status")
    )


def replace_group(table: DataFrame, group: str, rows: DataFrame) -> DataFrame:
    """Drop all rows of the groups that ``rows`` brings, then add ``rows``: repeating it changes nothing."""
    kept = delete_by_key(table, group, rows)
    return kept.select(*table.columns).unionByName(rows.select(*table.columns))


def overwrite_groups(rows: DataFrame, group: str, path: str) -> None:
    """The same on a table partitioned by the group: only the folders in ``rows`` are rewritten."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(group)
        .parquet(path)
    )


def generations(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the finished generations of a table, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = [n for n in names if n.startswith("generation-") and files.exists(path(f"{base}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("generation-")) for n in found)


def committed(spark: SparkSession, base: str) -> DataFrame:
    """The newest finished state of a table kept in generations."""
    return spark.read.parquet(f"{base}/generation-{generations(spark, base)[-1]}")


def commit(state: DataFrame, base: str) -> DataFrame:
    """Write a table's next state, which may be made of the present one, and read it back.

    It goes to a folder of its own and counts once it is whole, so readers of the present state are not disturbed and a
    run that dies leaves it in force.
    """
    spark = state.sparkSession
    number = max(generations(spark, base), default=0) + 1
    state.write.mode("overwrite").parquet(f"{base}/generation-{number}")
    return committed(spark, base)
