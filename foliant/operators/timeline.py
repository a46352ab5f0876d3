"""Sampling and lookup along a time axis.

Rows of one key may be many: positions and carried values come from ``plans.ordered``, and wherever
a group is reduced to a few samples the reduction is a plain aggregate, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from foliant.plans.ordered import ROWS_PER_BLOCK, Ordered, group_sizes, ordered
from foliant.plans.sizing import BROADCAST_ROWS, inlined, lookup_join, written

STRETCHES = 4_096  # of the time axis, whose rows are counted to find a numbered row of a large key


def flat_segments(intervals: DataFrame) -> DataFrame:
    """(begin, idx): where the first interval changes, over intervals (idx, start, end) that may nest and overlap.

    From each ``begin`` to the next one holds the least idx of the intervals that cover the stretch, or NULL. The ends
    are numbered; an interval covers a range of these numbers, which is the union of a few dyadic ranges (two of each
    size at most). Each dyadic range keeps its least idx, and a stretch looks at the ranges of all sizes around it.
    """
    spans = intervals.select("idx", "start", "end").where(F.col("end") > F.col("start"))
    ends = spans.select(F.col("start").alias("begin")).unionByName(spans.select(F.col("end").alias("begin"))).distinct()
    numbered = written(ordered(ends, [], ["begin"]).number("_no").rows(), "interval-ends")
    levels = max(1, numbered.count()).bit_length()
    covered = (
        spans.join(numbered.select(F.col("begin").alias("start"), (F.col("_no") - 1).alias("_from")), "start")
        .join(numbered.select(F.col("begin").alias("end"), (F.col("_no") - 1).alias("_to")), "end")
        .select("idx", "_from", "_to")
    )

    def ranges(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("bigint")
        low, high = F.floor((F.col("_from") + size - 1) / size), F.floor(F.col("_to") / size)
        both = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
        return F.transform(F.array_compact(both), lambda n: F.struct(level.alias("level"), n.alias("n")))

    dyadic = covered.select("idx", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), ranges))).alias("r"))
    least = dyadic.groupBy("r.level", "r.n").agg(F.min("idx").alias("idx"))
    around = numbered.select("begin", (F.col("_no") - 1).alias("_no"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    around = around.select("begin", "level", F.expr("shiftright(_no, level)").alias("n"))
    found = lookup_join(around, least, ["level", "n"], "left", spread_by=["begin"])
    return found.groupBy("begin").agg(F.min("idx").alias("idx"))


def interval_lookup(points: DataFrame, t: str, intervals: DataFrame, max_inline: int = 64) -> DataFrame:
    """Add ``idx`` of the first interval (idx, start, end) with start <= t < end, or NULL.

    Intervals may nest, overlap, repeat and be open (an infinite end); those whose end is null or not after their start hold
    nothing. A null t lies in none. A few intervals become an array literal, so the lookup is a projection. More are
    flattened into disjoint segments, and points and segments are sorted together once, so that each point takes the segment
    before it; the points may be any number, and so may be those between two segments.
    """
    at = F.col(f"`{t}`")
    spans = intervals.select("idx", "start", "end").where(F.col("end") > F.col("start"))
    few = spans.limit(max_inline + 1).collect()
    if not few:
        return points.withColumn("idx", F.lit(None).cast(intervals.schema["idx"].dataType))
    if len(few) <= max_inline:
        listed = F.array(
            *[
                F.struct(*[F.lit(r[c]).alias(c) for c in ("idx", "start", "end")])
                for r in sorted(few, key=lambda r: r["idx"])
            ]
        )
        hit = F.filter(listed, lambda s: (at >= s["start"]) & (at < s["end"]))
        return points.withColumn("idx", F.get(hit, F.lit(0))["idx"])
    segments = written(flat_segments(intervals), "segments")
    carrier = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    both = points.select(at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(f"struct<idx:{segments.schema['idx'].dataType.simpleString()}>").alias("_seg"), carrier.alias("_row")).unionByName(
        segments.select(F.col("begin").alias("_at"), F.lit(0).alias("_kind"), F.struct("idx").alias("_seg")), allowMissingColumns=True
    )
    carried = ordered(both, [], ["_at", "_kind"]).carry("_seg", "_held").rows().where("_kind = 1")
    return carried.select(*[F.col(f"_row.`{c}`") for c in points.columns], F.col("_held.idx").alias("idx"))


def carry_forward(
    points: DataFrame, keys: list[str], order: list[str], value: str, name: str, default: Column, **kw
) -> DataFrame:
    """On a gap the latest value stays; before any value the default holds."""
    return ordered(points, keys, order, **kw).carry(value, name, default).rows()


def even_timestamps(
    rows: DataFrame, keys: list[str], order: list[str], span: float = 10.0, **kw
) -> DataFrame:
    """Spread the rows of each key evenly over [0, span], to one decimal; a single row is at 0."""
    o = ordered(rows, keys, order, **kw).number("_no", "_n")
    step = F.lit(span) / F.greatest(F.col("_n") - 1, F.lit(1))
    t = F.bround((F.col("_no") - 1) * step, 1)
    return o.rows().withColumn("timestamp_sec", t).drop("_no", "_n")


def index_to_time(idx: Column, fps: Column) -> Column:
    return idx / fps


def sample_name(i: Column, seconds: Column, stem: str) -> Column:
    return F.format_string(stem + "_%d_%.2fs.jpg", i, seconds)


def sample_even_rows(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    start: float,
    duration: float,
    n: int,
    fps: float,
    **kw,
) -> DataFrame:
    """``n`` evenly spaced rows of each key between two times, both ends included.

    Rows count as frames from 0. An index at the end of the key has no row; a short range repeats rows. While keys are small
    all rows are numbered; otherwise rows are counted by stretches of the first order column, which say in which stretch a
    wanted frame lies, and only rows of these stretches are put in order.
    """
    _, largest = group_sizes(rows, keys)
    first = int(start * fps)

    def picked(totals: DataFrame) -> DataFrame:
        last = F.least(F.lit(int((start + duration) * fps)).cast("bigint"), F.col("_total"))
        picks = totals.select(*keys, last.alias("_last"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"))
        at = F.lit(float(first)) + F.col("_i") * (F.col("_last") - first) / max(n - 1, 1)
        return picks.select(*keys, (F.col("_i") + 1).alias("sample_no"), at.cast("bigint").alias("frame_number"))

    kind = rows.schema[order[0]].dataType
    if largest <= kw.get("rows_per_block", ROWS_PER_BLOCK) or not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        frames = ordered(rows, keys, order, **kw).number("_no").rows()
        frames = frames.withColumn("frame_number", F.col("_no") - 1).drop("_no")
        found = frames.join(picked(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))), [*keys, "frame_number"])
    else:
        found = _rows_of_frames(rows, keys, order, picked, **kw)
    return found.withColumn("timestamp", index_to_time(F.col("frame_number"), F.lit(fps)))


def _rows_of_frames(rows: DataFrame, keys: list[str], order: list[str], picked: Callable[[DataFrame], DataFrame], **kw) -> DataFrame:
    """The rows at the frames that ``picked`` makes of (keys, _total), numbering only the stretches where one lies."""
    kind = rows.schema[order[0]].dataType
    at = F.col(order[0]) if isinstance(kind, NumericType) else F.unix_micros(F.col(order[0]).cast("timestamp"))
    ends = rows.agg(F.min(at).cast("double").alias("low"), F.max(at).cast("double").alias("high")).first()
    low, width = ends["low"] or 0.0, max((ends["high"] or 0.0) - (ends["low"] or 0.0), 1e-9)
    # Rises with the order column; null comes first, as it does in the order.
    stretch = F.coalesce(F.floor((at.cast("double") - low) / width * STRETCHES).cast("int"), F.lit(-1))
    placed = rows.withColumn("_stretch", stretch)
    counts = written(placed.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_n")), "stretches")
    of_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picks = picked(counts.groupBy(*keys).agg(F.sum("_n").alias("_total")))
    # A wanted frame takes the last stretch that begins at or before it.
    begins = counts.select(*keys, before.alias("frame_number"), F.struct(F.col("_stretch").alias("s"), before.alias("b")).alias("_in"))
    both = begins.unionByName(picks, allowMissingColumns=True)
    held = F.last("_in", ignorenulls=True).over(of_key.orderBy("frame_number", F.col("sample_no").asc_nulls_first()))
    wanted = both.withColumn("_held", held).where("sample_no IS NOT NULL").select(
        *keys, "sample_no", "frame_number", F.col("_held.s").alias("_stretch"), (F.col("frame_number") - F.col("_held.b")).alias("_at")
    )
    wanted = written(wanted, "wanted-frames")
    chosen = lookup_join(placed, wanted.select(*keys, "_stretch").distinct(), [*keys, "_stretch"], "left_semi", spread_by=order)
    numbered = ordered(chosen, [*keys, "_stretch"], order, **kw).number("_no").rows().withColumn("_at", F.col("_no") - 1)
    return numbered.join(wanted, [*keys, "_stretch", "_at"]).drop("_stretch", "_at", "_no")


def sample_midpoints(
    rows: DataFrame, keys: list[str], t: str, tie: str, start: Column, duration: float, n: int = 4
) -> DataFrame:
    """First row at or after the middle of each of ``n`` equal slices of [start, start + duration).

    Each row is placed by arithmetic in the gap between two middles; the first row of each gap
    is an aggregate of at most n rows a key, and an empty gap falls through to the next one.
    """
    step = duration / n
    gap = F.floor((F.col(t) - start - step / 2) / step).cast("int")
    on_grid = F.when(start + F.least(gap, F.lit(n - 1)) * step + step / 2 <= F.col(t), gap).otherwise(gap - 1)
    # a row exactly on or past the next middle belongs there, whatever the division rounded to
    later = F.when((on_grid < n - 1) & (start + (on_grid + 1) * step + step / 2 <= F.col(t)), on_grid + 1)
    served = F.least(F.coalesce(later, on_grid), F.lit(n - 1))
    firsts = (
        rows.withColumn("_gap", served)
        .where(F.col("_gap") >= 0)
        .groupBy(*keys, "_gap")
        .agg(F.min(F.struct(t, tie)).alias("_first"))
    )
    by_key = firsts.groupBy(*keys).agg(F.collect_list(F.struct("_gap", "_first")).alias("_f"))
    picks = by_key.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    open_ = F.filter("_f", lambda f: f["_gap"] >= F.col("_i"))
    hit = F.array_min(F.transform(open_, lambda f: f["_first"]))
    target = start + F.col("_i") * step + step / 2
    return (
        picks.withColumn("_hit", hit)
        .where(F.col("_hit").isNotNull())
        .select(
            *keys,
            (F.col("_i") + 1).alias("sample_no"),
            target.alias("target"),
            F.col("_hit")[t].alias(t),
            F.col("_hit")[tie].alias(tie),
        )
    )


def prev_next(rows: DataFrame, keys: list[str], order: list[str], value: str, **kw) -> DataFrame:
    """Neighbours of each row; the first and last row are their own neighbours."""
    return ordered(rows, keys, order, **kw).neighbours(value, "prev_value", "next_value").rows()


def media_ordinals(media: DataFrame) -> Ordered:
    """Files in path order as text, so item 10 precedes item 2."""
    return ordered(media, [], ["path"]).number("ordinal", "n_items")


def link_media(documents: DataFrame, media: DataFrame, span: float = 10.0) -> DataFrame:
    """Every file of a folder linked to each matched document, spread evenly over the span.

    ``documents`` (link_id, document_id) is the first match of a search, one row for each folder;
    ``media`` is (link_id, path). The pair is an equi-join on the folder, not a cross product.
    """
    spaced = even_timestamps(media, ["link_id"], ["path"], span)
    found, rows = inlined(documents, BROADCAST_ROWS)
    bound = None if rows is None else len(rows)
    return lookup_join(spaced, found, ["link_id"], bounded_by=bound).select(
        "link_id", "document_id", F.col("path").alias("frame_path"), "timestamp_sec"
    )
