"""Vectors of whole numbers in blocks, and blocks of the asking vectors that meet all of them.

A block holds up to ``BLOCK`` rows of one length as flat arrays. Rows are packed where they are read, so no key decides
their block. Asking rows are copied once to each slot, a slot being a bounded number of blocks; a task holds the blocks
of one slot and lets the asking rows stream through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.base import picked
from foliant.llm.repeats import settle
from foliant.plans.sizing import spread

if TYPE_CHECKING:
    import pyarrow as pa

BLOCK_BITS = 14
BLOCK = 1 << BLOCK_BITS
CELLS = 4 << 20  # numbers in a block at most, whatever the length of its vectors
SLOT_BLOCKS = 16
PACKED = "number bigint, dim int, kind string, ids binary, labels binary, cells binary, extra binary"
_NAMES = ["number", "dim", "kind", "ids", "labels", "cells", "extra"]


@dataclass
class Block:
    """Rows of one length: ``cells`` holds whole numbers. A row's key is the block's number and its place."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    extra: bytes = b""
    kept: dict = field(default_factory=dict)  # what an operator derives from the block

    def keys(self) -> np.ndarray:
        return (self.number << BLOCK_BITS) + np.arange(len(self.ids))

    def asking(self, rows: np.ndarray, more: bytes = b"") -> Block:
        """Some rows as asking rows; they remember their own keys, and ``more`` about each of them."""
        own = self.keys()[rows].astype("<i8").tobytes()
        return Block(self.number, self.ids[rows], self.labels[rows], self.cells[rows], own + more)

    def own_keys(self) -> np.ndarray:
        """The keys that asking rows have in the blocks."""
        return np.frombuffer(self.extra, "<i8", len(self.ids))

    def more(self) -> bytes:
        return self.extra[8 * len(self.ids) :]

    def row(self) -> tuple:
        top = np.abs(self.cells).max(initial=0)
        kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "f8"
        return (
            self.number, self.cells.shape[1], kind, self.ids.astype("<i8").tobytes(), self.labels.astype("<i8").tobytes(),
            self.cells.astype(f"<{kind}").tobytes(), self.extra,
        )

    @classmethod
    def of(cls, number: int, dim: int, kind: str, ids: bytes, labels: bytes, cells: bytes, extra: bytes) -> Block:
        at = np.frombuffer(ids, "<i8")
        return cls(number, at, np.frombuffer(labels, "<i8"), np.frombuffer(cells, f"<{kind}").reshape(len(at), dim), extra)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two tables of whole numbers; OverflowError where 64 bits cannot hold one."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.array(whole(a.astype(np.float64)) @ whole(b.astype(np.float64)).T, np.int64).reshape(len(a), len(b))


def packed_batches(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    for block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block.row(), kinds, strict=True)], _NAMES)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block.of(*(batch.column(c)[i].as_py() for c in _NAMES))


def _packing(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def full(dim: int, least: int) -> Iterator[Block]:
            nonlocal number
            ids, labels, cells = (np.concatenate(x) for x in zip(*held[dim], strict=True))
            at = 0
            while len(ids) - at >= least:
                end = at + min(BLOCK, max(1, CELLS // max(1, dim)))
                yield Block(number, ids[at:end], labels[at:end], cells[at:end])
                number += 1
                at = end
            held[dim] = [(ids[at:], labels[at:], cells[at:])]

        for batch in batches:
            vectors = batch.column("vec")
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null as NaN
            ends = np.cumsum(sizes)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = vectors.is_valid().to_numpy(zero_copy_only=False) & (odd[ends] == odd[ends - sizes])
            ids, labels = (batch.column(c).cast(pa.int64()).to_numpy() for c in ("id", "label"))
            for dim in np.unique(sizes[good]).tolist():
                rows = np.flatnonzero(good & (sizes == dim))
                cells = np.floor(scale * values[(ends - sizes)[rows][:, None] + np.arange(dim)])
                held.setdefault(dim, []).append((ids[rows], labels[rows], cells))
                limit = min(BLOCK, max(1, CELLS // max(1, dim)))
                if sum(len(x[0]) for x in held[dim]) >= limit:
                    yield from full(dim, limit)
        for dim in sorted(held):
            yield from full(dim, 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_batches(blocks(batches))

    return pack


def packed(rows: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, label: str = "label", scale: int = 256) -> DataFrame:
    """Blocks of the vectors with each component x as floor(scale * x), written to the shared folder.

    ``label`` is SQL over id and label. Rows without id, with a label column those without label, rows whose vector is
    null, and those with a component that is null or not finite are left out.
    """
    names = {"id": id_col, "vec": vec_col} | ({"label": label_col} if label_col else {})
    slim = picked(rows, **names).select(
        F.col("id").cast("bigint").alias("id"),
        F.expr(label if label_col else "0").cast("bigint").alias("label"),
        F.col("vec").cast("array<double>").alias("vec"),
    )
    return settle(spread(slim.where("id IS NOT NULL AND label IS NOT NULL")).mapInArrow(_packing(scale), PACKED), "vector-blocks")


def slots_for(blocks: DataFrame) -> int:
    """Slots of at most about ``SLOT_BLOCKS`` blocks, and enough of them for the session's tasks."""
    n = blocks.count()
    return max(1, ceil(n / SLOT_BLOCKS), min(n, 2 * blocks.sparkSession.sparkContext.defaultParallelism))


Visit = Callable[[list[Block], Block], Iterator["pa.RecordBatch"]]


def meet(blocks: DataFrame, asked: DataFrame, slots: int, visit: Visit, schema: str) -> DataFrame:
    """``visit(blocks of a slot, asking block)`` for every asking block and every slot."""
    stored = blocks.select(F.expr(f"CAST(pmod((number >> 24) + 31 * (number & 16777215), {slots}) AS INT)").alias("slot"), F.lit(0).alias("turn"), *_NAMES)
    asking = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("turn"), *_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[Block]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                block = Block.of(*(row[c] for c in _NAMES))
                at = (row["slot"], row["dim"])
                if row["turn"] == 0:
                    held.setdefault(at, []).append(block)
                elif at in held:
                    yield from visit(held[at], block)

    both = stored.unionByName(asking).repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "turn")
    return both.mapInArrow(run, schema)
