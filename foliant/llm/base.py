"""Registry of the training-data queries and what their operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import ship

if TYPE_CHECKING:
    import pyarrow as pa

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows if there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def picked(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator works with.

    Everything else stays out, so extra columns cannot clash with an operator's own.
    """
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def in_batches(
    rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = 8 << 20
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size out of tuples."""
    import pyarrow as pa

    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= max_rows or size >= max_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty; one text is held at a time."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def give_back() -> None:
    """Give memory that is not used any more back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give memory back to the system when a task ends: its worker stays, and the next stage may need the room."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
