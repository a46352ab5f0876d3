"""Hard negatives by threshold joins over an inverted index with norm bounds.

A join finds the rows whose inner product with an anchor reaches the anchor's threshold. Dimensions are in order of their
weight in the block; for each row the lists of the trailing dimensions leave it out if the norm of that suffix times the
norm of any anchor stays below every threshold. Rows are sorted by how many dimensions they are listed under, so the list
of a dimension is a leading stretch of them. Partial scores are accumulated list by list; a pair is dropped once
its partial score plus the product of the remaining norms is below the threshold, and what is left is scored exactly.

An anchor's positives are the best rows of its label. Its windows of negatives reach down from each positive's score; they are
joined at a high threshold first, and the threshold is lowered for windows that are not full yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.catalog.base import table
from foliant.llm.base import in_batches, query
from foliant.llm.repeats import forget, settle
from foliant.llm.threshold import NONE, Top, whole_vectors_sql
from foliant.llm.vectors import PACKED, Block, meet, packed, packed_batches, products, slots_for, unpacked

if TYPE_CHECKING:
    import pyarrow as pa

K = 5
EVERY = 100
LOWEST = 80  # per cent of the positive's score
THRESHOLDS = (95, 88)  # per cent tried before the lowest
STRETCH = 8  # dimensions whose lists are read together


class Inverted:
    """The lists of a block: dimensions by falling weight, and the norms of every row's suffixes."""

    def __init__(self, block: Block):
        self.block = block
        cells = block.cells.astype(np.float64)
        self.order = np.argsort(-np.square(cells).sum(axis=0), kind="stable")
        squares = np.square(cells[:, self.order])
        self.starts = list(range(0, cells.shape[1], STRETCH))
        tails = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
        self.norms = np.sqrt(np.stack([tails[:, s] for s in self.starts] + [np.zeros(len(cells))], axis=1))
        most = np.abs(cells).max(initial=0)
        self.kind = np.float32 if most * most * cells.shape[1] < 2**24 else np.float64
        self.cells = cells[:, self.order].astype(self.kind)

    def reaching(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) whose score may reach the anchor's threshold: none that does is missing."""
        asked = anchors[:, self.order].astype(np.float64)
        tails = np.cumsum(np.square(asked)[:, ::-1], axis=1)[:, ::-1]
        asked_norms = np.sqrt(np.stack([tails[:, s] for s in self.starts] + [np.zeros(len(asked))], axis=1))
        spare = 1 + 1e-6 * asked_norms[:, 0].max(initial=0) * self.norms[:, 0].max(initial=0)
        least = thresholds.min(initial=np.inf) - spare
        # A row is listed under the stretches before the first suffix that cannot reach any threshold by itself.
        covered = self.norms * asked_norms[:, 0].max(initial=0) < least
        listed = np.where(covered.any(axis=1), covered.argmax(axis=1), len(self.starts))
        rows = np.argsort(-listed, kind="stable")
        listed = listed[rows]
        rows = rows[: np.searchsorted(-listed, 0)]  # a row without any list is out of reach
        bound = (thresholds - spare)[:, None]
        if not len(self.starts):
            return np.nonzero(np.broadcast_to(bound <= 0, (len(asked), len(self.block.ids))))
        partial = np.zeros((len(asked), len(rows)), self.kind)
        alive = np.ones(partial.shape, bool)
        norms = self.norms[rows]
        for s, start in enumerate(self.starts):
            n = int(np.searchsorted(-listed, -s, side="left"))  # rows listed under more than s stretches
            if n == 0:
                break
            at = slice(start, start + STRETCH)
            partial[:, :n] += asked[:, at].astype(self.kind) @ self.cells[rows[:n], at].T
            alive[:, :n] &= partial[:, :n] + asked_norms[:, s + 1, None] * norms[None, :n, s + 1] >= bound
            if np.count_nonzero(alive) * 16 < alive.size:
                break  # few pairs are left: they are scored at once
        anchor, row = np.nonzero(alive)
        return anchor, rows[row]


def inverted(block: Block) -> Inverted:
    if "inverted" not in block.kept:
        block.kept["inverted"] = Inverted(block)
    return block.kept["inverted"]


def joined(block: Block, anchors: Block, thresholds: np.ndarray, same_label: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores) with a score of at least the anchor's threshold; the anchor itself is left out."""
    own, keys = anchors.own_keys(), block.keys()
    anchor, row = inverted(block).reaching(anchors.cells, thresholds)
    good = (block.labels[row] == anchors.labels[anchor]) == same_label
    good &= keys[row] != own[anchor]
    anchor, row = anchor[good], row[good]
    ends = np.searchsorted(anchor, np.arange(len(anchors.ids) + 1))
    for i in np.flatnonzero(np.diff(ends)):
        found = row[ends[i] : ends[i + 1]]
        scores = products(block.cells[found], anchors.cells[i : i + 1])[:, 0]
        reach = scores >= thresholds[i]
        yield int(i), found[reach], scores[reach]


def _anchoring(every: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The anchors among the rows of each block, with the k-th score that each has with its label in its own block."""

    def asked(blocks: Iterator[Block]) -> Iterator[Block]:
        for block in blocks:
            anchors = block.asking(np.flatnonzero(block.ids % every == 0))
            if not len(anchors.ids):
                continue
            known = np.full(len(anchors.ids), NONE, "<i8")
            for i, _, scores in joined(block, anchors, np.full(len(known), -np.inf), True):
                if len(scores) >= k:
                    known[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield Block(anchors.number, anchors.ids, anchors.labels, anchors.cells, anchors.extra + known.tobytes())

    return lambda batches: packed_batches(asked(unpacked(batches)))


def _rows_of(tops: dict[tuple, Top], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    rows = (
        (*at, int(vec), int(row), int(score))
        for at, top in tops.items()
        for score, vec, row in zip(top.scores, top.ids, top.keys, strict=True)
    )
    return in_batches(rows, pa.schema([(c, pa.int64()) for c in (*names, "vec_id", "row", "score")]))


def _positives(k: int) -> Callable[[list[Block], Block], Iterator[pa.RecordBatch]]:
    def find(blocks: list[Block], anchors: Block) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(anchors.more(), "<i8")
        tops = [Top(k, None if x == NONE else int(x)) for x in known]
        for block in blocks:
            for i, rows, scores in joined(block, anchors, np.array([t.least for t in tops], np.float64), True):
                tops[i].add(scores, block.ids[rows], block.keys()[rows])
        found = {(int(key), int(i)): top for key, i, top in zip(anchors.own_keys(), anchors.ids, tops, strict=True)}
        yield from _rows_of(found, ("key", "anchor_id"))

    return find


def _negatives(k: int) -> Callable[[list[Block], Block], Iterator[pa.RecordBatch]]:
    def find(blocks: list[Block], anchors: Block) -> Iterator[pa.RecordBatch]:
        windows = np.frombuffer(anchors.more(), "<i8").reshape(-1, 4)  # place of the anchor, positive, lowest and highest score
        if not len(windows):
            return
        asked = np.unique(windows[:, 0])
        some = Block(anchors.number, anchors.ids[asked], anchors.labels[asked], anchors.cells[asked], anchors.own_keys()[asked].tobytes())
        place = np.searchsorted(asked, windows[:, 0])
        own = anchors.own_keys()
        tops = {(int(own[w[0]]), int(w[1])): Top(k) for w in windows}
        by_anchor = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[by_anchor], np.arange(len(asked) + 1))
        for block in blocks:
            # What the windows of an anchor still need: a full one only what beats its last row.
            needed = [max(float(w[2]), tops[int(own[w[0]]), int(w[1])].least) for w in windows]
            lowest = np.full(len(asked), np.inf)
            np.minimum.at(lowest, place, needed)
            for i, rows, scores in joined(block, some, lowest, False):
                for at, positive, low, high in windows[by_anchor[ends[i] : ends[i + 1]]]:
                    inside = (scores >= low) & (scores <= high)
                    tops[int(own[at]), int(positive)].add(scores[inside], block.ids[rows[inside]], block.keys()[rows[inside]])
        yield from _rows_of(tops, ("key", "positive"))

    return find


def _windowing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors whose open windows come as a list, to anchors that carry them packed."""

    def asked() -> Iterator[Block]:
        for batch in batches:
            for i in range(batch.num_rows):
                (block,) = unpacked(iter([batch.slice(i, 1)]))
                place = {int(key): at for at, key in enumerate(block.own_keys())}
                windows = [(place[w["key"]], w["positive"], w["low"], w["high"]) for w in batch.column("windows")[i].as_py()]
                packed_windows = np.array(sorted(windows), "<i8").tobytes()
                yield Block(block.number, block.ids, block.labels, block.cells, block.own_keys().tobytes() + packed_windows)

    return packed_batches(asked())


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    label: str = "label",
    every: int = EVERY,
    k: int = K,
    lowest: int = LOWEST,
    scale: int = 256,
) -> DataFrame:
    """Per anchor and positive the first ``k`` negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x count as floor(scale * x); a row's score is its exact inner product with the anchor, higher scores come first, ties by
    smaller id. Anchors are the rows whose id is divisible by ``every``, their positives the first ``k`` other rows of the same label.
    Negatives of a positive have another label and a score of ``lowest`` to 100 per cent of the positive's; a negative positive_score
    has none. ``label`` is SQL over id and label that corrects labels first.

    Rows without id or label, and vectors that are null or have a component that is null or not finite, take no part; vectors
    of different length are never compared. Rows that share an id are rows of their own. Where fewer than ``k`` fit, all are returned;
    an empty table, or one with a single label, gives no rows. A score beyond 64 bits is an error. Other columns are not looked at.
    """
    blocks = packed(rows, id_col, vec_col, label_col, label, scale)
    slots = slots_for(blocks)
    anchors = settle(blocks.mapInArrow(_anchoring(every, k), PACKED), "anchors")
    found = meet(blocks, anchors, slots, _positives(k), "key bigint, anchor_id bigint, vec_id bigint, row bigint, score bigint")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row")
    positives = settle(found.withColumn("positive", F.row_number().over(order).cast("bigint")).where(F.col("positive") <= k), "positives")

    full: list[DataFrame] = []
    windows = positives.where("score >= 0").select("key", "positive", F.col("score").alias("high"))
    for percent in [*(p for p in THRESHOLDS if p > lowest), lowest]:
        low = F.expr(f"CAST(ceil(CAST(high AS DECIMAL(38,0)) * {percent} / 100) AS BIGINT)")
        carried = windows.select(F.expr("shiftright(key, 14)").alias("number"), F.struct("key", "positive", low.alias("low"), "high").alias("w"))
        lists = carried.groupBy("number").agg(F.collect_list("w").alias("windows"))  # at most k for each anchor of a block
        asked = settle(anchors.join(lists, "number").mapInArrow(_windowing, PACKED), "open-windows")
        met = meet(blocks, asked, slots, _negatives(k), "key bigint, positive bigint, vec_id bigint, row bigint, score bigint")
        best = Window.partitionBy("key", "positive").orderBy(F.desc("score"), "vec_id", "row")
        inside = settle(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "negatives")
        if percent == lowest:
            full.append(inside)
            break
        done = inside.where(F.col("rank") == k).select("key", "positive")
        full.append(inside.join(done, ["key", "positive"], "left_semi"))
        forget(rows.sparkSession, asked)
        windows = settle(windows.join(done, ["key", "positive"], "left_anti"), "windows")
        if windows.isEmpty():
            break
    negatives = full[0]
    for part in full[1:]:
        negatives = negatives.unionByName(part)
    named = negatives.select("key", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(positives, ["key", "positive"]).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )


MOVED = "CASE WHEN pmod(id, 7) = 0 THEN (label + 1) % 10 ELSE label END"
OP13_SQL = f"""
WITH e AS ({whole_vectors_sql("vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")} AND label IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id AND len(a.v) = len(e.v) WHERE a.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=MOVED)
