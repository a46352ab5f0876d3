"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``width`` bytes only, digit after digit, and only so far as they may still be
equal to another: groups of one leave after each pass, and the groups that are left at full depth are exactly the
repeated windows. So that not every byte of the corpus becomes a row, neighbouring suffixes travel as one bundle as long
as they share the digit of the pass:

1. The first digit of a suffix is its pivot: of all grams of ``GRAM`` bytes inside the window the one with the least
   hash. Equal windows have equal pivots at equal places. Neighbours with the same pivot are one run.
2. All bytes of a run. Equal runs are repeated as wholes; a run alone with its pivot is done.
3. The bytes that all windows of a cell (``CELL`` neighbours at fixed places before the pivot) have in common.
4. The rest of each single window of the cells whose common bytes are shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import in_batches, query
from foliant.llm.repeats import chunks, forget, settle, tagged, with_lists

if TYPE_CHECKING:
    import pyarrow as pa

WIDTH = 200
CELL = 16
WIDEST = (1 << 12) - 1  # a place packs windows and pivot into 12 bits each
POSITION = 22  # bits of a place inside a segment
SEGMENT = 1 << 21  # a longer text is cut into segments that overlap by a window

_random = np.random.default_rng(20_011)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = _random.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.uint64((1 << POSITION) - 1)


def gram_length(width: int) -> int:
    """The largest power of two up to a third of the window."""
    return 1 << max(width // 3, 1).bit_length() - 1


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    h, size, level = _BYTE[text], 1, 0
    while size < gram:
        h = h[:-size] * _STEP[level] + h[size:]
        size, level = size * 2, level + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(32)


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of ``width`` values."""
    least, size = values, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def runs_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one pivot: text number, start, windows, pivot's place after the start, pivot
    hash and hash of all bytes of the run. Texts together must be shorter than 2 ** POSITION."""
    import xxhash

    gram = gram_length(width)
    joined = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    empty = np.empty(0, np.int64)
    if len(joined) < width:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    hashes = _gram_hashes(np.frombuffer(joined, np.uint8), gram)
    keys = hashes & ~_MASK | np.arange(len(hashes), dtype=np.uint64)
    pivots = (_least_in(keys, width - gram + 1) & _MASK).astype(np.int64)
    # Windows that cross into the next text are no windows.
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(pivots)]
    inside = np.arange(len(pivots)) + width <= (begins + sizes)[owner]
    changes = np.ones(len(pivots), bool)
    changes[1:] = (pivots[1:] != pivots[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(changes)
    after = np.append(first[1:], len(pivots))
    first, after = first[inside[first]], after[inside[first]]
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(joined)
    whole = np.fromiter(
        (digest(view[a:b]) for a, b in zip(first.tolist(), (after + width - 1).tolist(), strict=True)), np.uint64, len(first)
    )
    number = owner[first]
    return number, first - begins[number], after - first, pivots[first] - first, hashes[pivots[first]], whole


def _segments(texts: list[bytes], width: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, the long ones cut into overlapping segments, in groups that ``runs_of`` can take."""
    numbers: list[int] = []
    offsets: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for begin in range(0, max(len(text) - width + 1, 1), SEGMENT):
            part = text[begin : begin + SEGMENT + width - 1]
            if size + len(part) >= 1 << POSITION:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(i)
            offsets.append(begin)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


def pack_place(start: np.ndarray, windows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """A run's start, number of windows and pivot place in one whole number."""
    return start << 24 | windows << 12 | pivot


def _running(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for rows, texts, batch in chunks(batches):
            for numbers, offsets, parts in _segments(texts, width):
                number, start, windows, pivot_at, pivot, whole = runs_of(parts, width)
                if not len(number):
                    continue
                take = pa.array(np.asarray(rows)[np.asarray(numbers)[number]])
                place = pack_place(start + np.asarray(offsets, np.int64)[number], windows, pivot_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("tag").take(take),
                        pa.array(place),
                        pa.array(pivot.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                    ],
                    ["doc_id", "tag", "place", "pivot", "whole"],
                )

    return run


def cells_of(text: bytes, start: int, windows: int, pivot: int, width: int = WIDTH) -> Iterator[tuple[bytes, bytes, bytes, int, int]]:
    """The cells of a run: digest of what all their windows share, bytes left and right of it, first and last window."""
    import xxhash

    at = start + pivot
    last = start + windows - 1
    for cell in range((at - last) // CELL, (at - start) // CELL + 1):
        high = at - cell * CELL  # start of the cell's last window
        low = high - CELL + 1
        core = text[high : low + width]
        first_here, last_here = max(low, start), min(high, last)
        yield (
            xxhash.xxh3_128_digest(core, seed=cell),
            text[first_here:high],
            text[low + width : last_here + width],
            first_here,
            last_here,
        )


def _opening(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, tag, text, found in zip(
                batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("found"), strict=True
            ):
                content = text.as_py()
                for packed in found.as_py():
                    place, undecided = packed >> 1, bool(packed & 1)
                    for core, left, right, low, high in cells_of(content, place >> 24, place >> 12 & 0xFFF, place & 0xFFF, width):
                        yield doc, tag, core, left, right, low, high, undecided

        for batch in batches:
            kinds = [("doc_id", batch.column("doc_id").type), ("tag", pa.int64())]
            schema = pa.schema(
                [*kinds, ("core", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("undecided", pa.bool_())]
            )
            yield from in_batches(rows(batch), schema)

    return open_cells


def repeated_stretches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tag, stretch): stretches of windows, start << 32 | end in bytes, that are repeated somewhere.

    ``docs`` are rows of ``tagged``.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = lambda low, high: F.expr(f"shiftleft(CAST({low} AS BIGINT), 32) | ({high} + {width})").alias("stretch")
    runs = settle(docs.mapInArrow(_running(width), f"doc_id {kind}, tag bigint, place bigint, pivot bigint, whole bigint"), "suffix-runs")

    # Digits that occur twice are written before they are joined: then both sides of each join are plain exchanges, and
    # Spark can split the partitions of hot digits.
    twice = lambda rows, key: settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), f"suffix-{key}")

    # Pass 1: runs alone with their pivot leave.
    pivots = twice(runs, "pivot")
    shared = settle(runs.join(pivots, "pivot"), "suffix-shared")
    forget(spark, runs, pivots)

    # Pass 2: runs with all bytes equal are repeated; different runs with one pivot are opened, one of each.
    wholes = settle(
        shared.groupBy("pivot", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tag", "place")).alias("one")),
        "suffix-wholes",
    )
    equal = shared.join(wholes.where("n > 1").select("pivot", "whole"), ["pivot", "whole"]).select(
        "doc_id", "tag", span("shiftrightunsigned(place, 24)", "shiftrightunsigned(place, 24) + (shiftrightunsigned(place, 12) & 4095) - 1")
    )
    mixed = twice(wholes, "pivot")
    opened = wholes.join(mixed, "pivot").select(
        "one.doc_id", "one.tag", F.expr("shiftleft(one.place, 1) | IF(n = 1, 1, 0)").alias("packed")
    )

    # Pass 3: cells by the bytes that all their windows share.
    cell_rows = f"doc_id {kind}, tag bigint, core binary, left binary, right binary, low bigint, high bigint, undecided boolean"
    cells = settle(with_lists(docs, opened, "packed", "inner").mapInArrow(_opening(width), cell_rows), "suffix-cells")
    owner = F.min(F.struct("doc_id", "tag", "low", "high", "undecided")).alias("one")
    full = settle(
        cells.groupBy("core", "left", "right").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.min("high").alias("high"), owner),
        "suffix-full",
    )
    equal_cells = (
        cells.where("undecided")
        .join(full.where("n > 1").select("core", "left", "right"), ["core", "left", "right"])
        .select("doc_id", "tag", span("low", "high"))
    )
    cores = twice(full, "core")

    # Pass 4: single windows, told apart by what they have left and right of the shared bytes.
    before = F.expr("octet_length(left) - (window - one.low)")  # bytes of the window left of the shared ones
    windows = (
        full.join(cores, "core")
        .select("core", "left", "right", "one", F.expr("n = 1 AND one.undecided").alias("undecided"), F.explode(F.expr("sequence(one.low, one.high)")).alias("window"))
        .withColumn("before", before)
        .select(
            F.expr(
                "unhex(md5(concat(core, to_binary(lpad(hex(before), 2, '0'), 'hex'), "
                f"substring(left, octet_length(left) - before + 1, before), substring(right, 1, {CELL - 1} - before))))"
            ).alias("digit"),
            "one.doc_id",
            "one.tag",
            "window",
            "undecided",
        )
    )
    windows = settle(windows, "suffix-windows")
    digits = twice(windows, "digit")
    single = windows.where("undecided").join(digits, "digit").select("doc_id", "tag", span("window", "window"))
    found = settle(equal.unionByName(equal_cells).unionByName(single), "suffix-stretches")
    forget(spark, shared, wholes, mixed, cells, full, cores, windows, digits)
    return found


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    for batch in batches:
        numbers, spans, kept = [], [], []
        for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found"), strict=True):
            content = text.as_py()
            numbers.append(len(content))
            merged: list[tuple[int, int]] = []
            parts, at = [], 0
            for packed in sorted(found.as_py() or ()):
                low, high = packed >> 32, packed & 0xFFFFFFFF
                if merged and low <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
                else:
                    merged.append((low, high))
            for low, high in merged:
                parts.append(content[at:low])
                at = high
            parts.append(content[at:])
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(parts))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (start, end of each removed run), kept (the bytes that are left).

    A byte is removed if it lies in a string of ``width`` bytes that also starts anywhere else, in the same document or
    another; all occurrences go, and strings are judged on the texts as they came. Null counts as empty; texts shorter
    than ``width`` (32 to 4,095) are kept whole. A null doc_id is kept as it is. Rows with equal texts lose all that is as long as the
    window, whether or not they share an id. Texts of 4 GiB and more are not supported (Spark's strings end at 2 GiB).
    """
    if not 2 * CELL <= width <= WIDEST:
        raise ValueError(f"width must be {2 * CELL} to {WIDEST}")
    texts = tagged(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return with_lists(texts, repeated_stretches(texts, width), "stretch", "left").mapInArrow(_removing, rows)


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
