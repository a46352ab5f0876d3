"""Window work over ordered groups that may be arbitrarily large.

A plain window puts all rows of a key in one task. ``ordered`` counts the rows by key
first (one aggregate over the key column alone). While the largest group fits a task, the plain
window is used. Otherwise the rows are range-partitioned by key and order and written once,
so that each key is cut into consecutive blocks of bounded size; windows run inside the blocks, and one
summary row for each block and key carries numbers and values over the block borders.
Both forms give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliant.plans.sizing import written

ROWS_PER_BLOCK = 2_000_000
BROADCAST_SUMMARY = 20_000
BLOCK = "_blk"


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: list[str]
    order: list[str]
    blocks: int = 0

    @property
    def split(self) -> bool:
        return self.blocks > 0

    def _window(self) -> WindowSpec:
        parts = [*self.keys, BLOCK] if self.split else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    def _across(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def spanning(self, summary: DataFrame) -> DataFrame:
        """The summary rows of keys that lie in several blocks; the others have nothing to carry.

        Blocks follow the keys, so at most one key crosses each border and twice the number of
        blocks bounds the rows.
        """
        n = F.count(F.lit(1)).over(Window.partitionBy(*self.keys))
        return summary.withColumn("_blocks", n).where(F.col("_blocks") > 1).drop("_blocks")

    def attach(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """Bring the summary row of each (key, block) to the rows of the block; NULL where there is none."""
        names = [*self.keys, BLOCK]
        if 2 * self.blocks <= BROADCAST_SUMMARY:
            summary = F.broadcast(summary)
        right = summary.select(
            *[F.col(n).alias(f"_r_{n}") for n in names],
            *[c for c in summary.columns if c not in names],
        )
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
        return df.join(right, same, "left").drop(*[f"_r_{n}" for n in names])

    def _with(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.order, self.blocks)

    def rows(self) -> DataFrame:
        return self.df.drop(BLOCK) if self.split else self.df

    def number(self, name: str, total: str | None = None) -> "Ordered":
        """1-based position in the group and, on request, the size of the group."""
        w = self._window()
        if not self.split:
            out = self.df.withColumn(name, F.row_number().over(w).cast("bigint"))
            if total:
                out = out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
            return self._with(out)
        sizes = self.spanning(self.df.groupBy(*self.keys, BLOCK).agg(F.count(F.lit(1)).alias("_n")))
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if total:
            sizes = sizes.withColumn("_total", F.sum("_n").over(Window.partitionBy(*self.keys)))
        local = self.df.withColumn("_rn", F.row_number().over(w))
        if total:
            whole_block = Window.partitionBy(*self.keys, BLOCK)
            local = local.withColumn("_here", F.count(F.lit(1)).over(whole_block))
        out = self.attach(local, sizes.drop("_n"))
        before_block = F.coalesce("_before", F.lit(0))
        out = out.withColumn(name, (F.col("_rn") + before_block).cast("bigint"))
        if total:
            out = out.withColumn(total, F.coalesce("_total", "_here"))
        return self._with(out.drop("_rn", "_before", "_total", "_here"))

    def carry(self, source: str, name: str, default: Column | None = None) -> "Ordered":
        """Latest non-null ``source`` at or before each row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latest = F.last(source, ignorenulls=True).over(w)
        if not self.split:
            value = latest if default is None else F.coalesce(latest, default)
            return self._with(self.df.withColumn(name, value))
        at = F.when(F.col(source).isNotNull(), F.struct(*self.order))
        ends = self.df.groupBy(*self.keys, BLOCK).agg(F.max_by(F.col(source), at).alias("_end"))
        ends = self.spanning(ends)
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        out = self.attach(self.df.withColumn("_local", latest), ends)
        parts = [F.col("_local"), F.col("_carried")] + ([] if default is None else [default])
        return self._with(out.withColumn(name, F.coalesce(*parts)).drop("_local", "_carried"))

    def neighbours(self, source: str, prev_name: str, next_name: str) -> "Ordered":
        """Values of ``source`` one row before and after, clamped to the row itself at the ends."""
        w = self._window()
        here = F.struct(F.col(source).alias("v"))
        out = self.df.withColumn("_p", F.lag(here).over(w)).withColumn("_n", F.lead(here).over(w))
        if self.split:
            at = F.struct(*self.order)
            edges = self.df.groupBy(*self.keys, BLOCK).agg(
                F.min_by(here, at).alias("_first"), F.max_by(here, at).alias("_last")
            )
            edges = self.spanning(edges)
            edges = edges.withColumn("_before", F.lag("_last").over(self._across())).withColumn(
                "_after", F.lead("_first").over(self._across())
            )
            out = self.attach(out, edges.drop("_first", "_last"))
            out = out.withColumn("_p", F.coalesce("_p", "_before")).withColumn(
                "_n", F.coalesce("_n", "_after")
            )
        out = out.withColumn(prev_name, F.coalesce("_p", here)["v"]).withColumn(
            next_name, F.coalesce("_n", here)["v"]
        )
        return self._with(out.drop("_p", "_n", "_before", "_after"))


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, rows of the largest group); only the key columns are read."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    return row["rows"] or 0, row["largest"] or 0


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows_per_block: int = ROWS_PER_BLOCK,
    sized_by: DataFrame | None = None,
) -> Ordered:
    """``order`` is ascending and must be unique inside a key.

    ``sized_by`` may name a cheaper table with at least the same rows by key to count.
    """
    rows, largest = group_sizes(df if sized_by is None else sized_by, keys)
    if largest <= rows_per_block:
        return Ordered(df, keys, order)
    n = max(2, ceil(rows / rows_per_block))
    cut = df.repartitionByRange(n, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return Ordered(written(cut, "blocks"), keys, order, n)
