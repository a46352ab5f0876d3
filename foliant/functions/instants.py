"""Timestamps as microseconds, the same for columns with and without a time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

MICROS = 1_000_000


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(df: DataFrame, ts: str) -> Column:
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts))
    return F.unix_micros(ts)


def from_micros(us: Column, kind: DataType) -> Column:
    if isinstance(kind, TimestampNTZType):
        days, rest = F.floor(us / (86400 * MICROS)), F.pmod(us, F.lit(86400 * MICROS))
        return _epoch() + F.make_dt_interval(days.cast("int")) + F.make_dt_interval(
            secs=(rest.cast("decimal(18,0)") / MICROS).cast("decimal(18,6)")
        )
    return F.timestamp_micros(us)
