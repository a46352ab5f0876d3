"""Row filters and key lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import is_blank, strip
from foliant.plans.sizing import lookup_join


def digits_only(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def get_by_id(table: DataFrame, key: str, requested: DataFrame, requested_key: str) -> DataFrame:
    """Rows whose id is requested; requests are text and count only if all digits."""
    asked = F.trim(F.col(requested_key))
    ids = requested.where(digits_only(asked)).select(asked.try_cast("bigint").alias(key)).distinct()
    return lookup_join(table, ids, [key], "left_semi", bounded_by=requested)


def exists_key(probes: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Flag each probe row by whether its key stands in the table, which is only filtered by the probes' keys."""
    asked = probes.select(key).where(F.col(key).isNotNull()).distinct()
    keys = table.select(F.col(table_key).alias(key))
    present = lookup_join(keys, asked, [key], "left_semi", bounded_by=probes).distinct().withColumn("_hit", F.lit(True))
    found = lookup_join(probes, present, [key], "left", bounded_by=probes)
    return found.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def filter_types(df: DataFrame, column: str, kept: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(kept))


def drop_blank(df: DataFrame, columns: list[str], mode: str = "any") -> DataFrame:
    """Drop rows where any, or all, of the columns are blank."""
    blanks = [is_blank(F.col(c)) for c in columns]
    blank = reduce(lambda a, b: a | b if mode == "any" else a & b, blanks)
    return df.where(~blank)


def min_arity(df: DataFrame, values: str, n: int = 21) -> DataFrame:
    return df.where(F.size(values) >= n)


def default_created(c: Column, now: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), now)


def allowed_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Normalise a column and flag whether the value is allowed."""
    value = F.lower(strip(F.col(column)))
    return df.withColumn(column, value).withColumn("valid", F.coalesce(value.isin(allowed), F.lit(False)))
