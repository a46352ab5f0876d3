"""Aggregates that report: listings, throughput, import counts and command routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import command_args, command_name
from foliant.plans.ordered import ordered
from foliant.plans.sizing import lookup_join


def render_listing(
    rows: DataFrame, by: list[str], key: str, title: str, template: str, page_rows: int = 1_000
) -> DataFrame:
    """Formatted lines joined in key order, in pages of at most ``page_rows`` lines for each group."""
    lines = rows.select(*by, key, F.format_string(template, F.col(key), F.col(title)).alias("_line"))
    numbered = ordered(lines, by, [key]).number("_no").rows()
    paged = numbered.withColumn("listing_page", F.floor((F.col("_no") - 1) / page_rows).cast("bigint") + 1)
    in_order = F.array_sort(F.collect_list(F.struct("_no", "_line")))
    return paged.groupBy(*by, "listing_page").agg(
        F.array_join(F.transform(in_order, lambda r: r["_line"]), "\n").alias("listing"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def with_empty_message(groups: DataFrame, listing: DataFrame, by: list[str], message: str) -> DataFrame:
    """Groups without any line show a message."""
    empty = lookup_join(groups.select(*by).distinct(), listing.select(*by).distinct(), by, "left_anti")
    notes = empty.withColumn("listing_page", F.lit(1).cast("bigint")).withColumn("listing", F.lit(message))
    return listing.unionByName(notes.withColumn("n_lines", F.lit(0).cast("bigint")))


def per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def throughput_stats(runs: DataFrame, by: list[str], n: str, seconds: str) -> DataFrame:
    """Rate of each run to 2 places, then mean and best by group."""
    tps = F.bround(per_second(F.col(n), F.col(seconds)), 2)
    timed = runs.withColumn("_tps", tps).withColumn("_time", F.bround(F.col(seconds).cast("double"), 2))
    return timed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.bround(F.avg("_tps"), 4).alias("avg_tps"),
        F.max("_tps").alias("max_tps"),
        F.sum("_time").alias("total_time"),
    )


def route_commands(log: DataFrame, command: str, handlers: DataFrame) -> DataFrame:
    """First word looked up among (cmd, handler); words without a handler give an error text."""
    split = log.withColumn("cmd", command_name(F.col(command))).withColumn(
        "args", command_args(F.col(command))
    )
    joined = lookup_join(split, handlers, ["cmd"], "left")
    unknown = F.concat(F.lit("Unknown command: "), F.col("cmd"))
    return joined.where(F.col("cmd") != "").withColumn(
        "output", F.when(F.col("handler").isNull(), unknown)
    )
