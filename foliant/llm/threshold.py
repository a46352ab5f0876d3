"""Exact top-k by inner product with Fagin's threshold algorithm.

Every block of vectors has a sorted list for each dimension. A query reads its lists from the end that is good for it, a
positive component from the top, a negative one from the bottom, all to the same depth; rows that it meets are scored
exactly, and it stops when the sum of what the lists show next cannot reach its k-th score. The lists also tell
beforehand how deep they would have to be read for a score that is known already: at depth 0 the block is skipped.

A query is answered in its own block first; the k-th score found there is a bound in all other blocks.
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
from foliant.llm.repeats import settle
from foliant.llm.vectors import PACKED, Block, meet, packed, packed_batches, products, slots_for, unpacked

if TYPE_CHECKING:
    import pyarrow as pa

K = 5
EVERY = 50
FIRST_DEPTH = 4


class Lists:
    """The sorted lists of a block, and what they show at depths 0, 4, 8, 16 .. and at their end."""

    def __init__(self, block: Block):
        self.block = block
        self.cells = block.cells
        self.rows = np.argsort(self.cells, axis=0, kind="stable")
        n = len(self.cells)
        depths = [0]
        while depths[-1] < n:
            depths.append(min(n, max(FIRST_DEPTH, 2 * depths[-1])))
        self.depths = np.array(depths)
        ordered = np.take_along_axis(self.cells, self.rows, axis=0).astype(np.float64)
        shown = self.depths[:-1]
        self.lowest, self.highest = ordered[shown], ordered[n - 1 - shown]

    def bounds(self, asking: np.ndarray) -> np.ndarray:
        """(query, depth): no row below that depth in all lists scores more; minus infinity at the end."""
        found = np.maximum(asking, 0) @ self.highest.T + np.minimum(asking, 0) @ self.lowest.T
        spare = 1e-9 * (np.abs(asking).sum(axis=1) * np.abs(self.cells).max(initial=0))[:, None]
        return np.concatenate([found + spare, np.full((len(asking), 1), -np.inf)], axis=1)

    def read(self, asked: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Rows that stand in the lists of a query between two depths."""
        n = len(self.cells)
        up, down = np.flatnonzero(asked > 0), np.flatnonzero(asked < 0)
        return np.concatenate([self.rows[n - end : n - begin, up].ravel(), self.rows[begin:end, down].ravel()])


class Top:
    """The best ``k`` rows of a query so far: highest score first, then least id, then least key."""

    def __init__(self, k: int, least: int | None = None):
        self.k, self.known = k, least
        self.scores = self.ids = self.keys = np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """Rows with a lower score than this are not among the best."""
        here = int(self.scores[-1]) if len(self.scores) == self.k else None
        both = [x for x in (here, self.known) if x is not None]
        return max(both) if both else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        s, i, k = (np.concatenate([old, new[good]]) for old, new in ((self.scores, scores), (self.ids, ids), (self.keys, keys)))
        if len(s) > 4 * self.k:  # only scores that can be among the best are put in order
            near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i, k = s[near], i[near], k[near]
        best = np.lexsort((k, i, -s))[: self.k]
        self.scores, self.ids, self.keys = s[best], i[best], k[best]


def search(lists: Lists, asking: Block, tops: list[Top]) -> np.ndarray:
    """Bring the rows of a block that belong to the best of each query into ``tops``; returns the rows read by query."""
    n = len(lists.cells)
    read = np.zeros(len(tops), np.int64)
    if n == 0:
        return read
    bounds = lists.bounds(asking.cells.astype(np.float64))
    own, keys, ids = asking.own_keys(), lists.block.keys(), lists.block.ids
    whole: list[int] = []
    for i, top in enumerate(tops):
        asked = asking.cells[i]
        lists_read = np.count_nonzero(asked)
        seen = np.zeros(n, bool)
        for step, (begin, end) in enumerate(zip(lists.depths, lists.depths[1:], strict=False)):
            if bounds[i, step] < top.least:
                break
            # Where it would have to read as many entries as there are rows, all rows are scored at once instead.
            stop = lists.depths[np.argmax(bounds[i] < top.least)] if top.least > -np.inf else end
            if lists_read == 0 or max(stop, end) * lists_read >= n:
                whole.append(i)
                break
            before = seen.copy()
            seen[lists.read(asked, begin, end)] = True
            new = np.flatnonzero(seen & ~before)
            new = new[keys[new] != own[i]]
            top.add(products(lists.cells[new], asked[None])[:, 0], ids[new], keys[new])
        read[i] = seen.sum()
    for begin in range(0, len(whole), 256):
        some = whole[begin : begin + 256]
        scores = products(asking.cells[some], lists.cells)
        for i, row in zip(some, scores, strict=True):
            good = np.flatnonzero((row >= tops[i].least) & (keys != own[i]))
            if len(tops[i].scores):
                good = good[~np.isin(keys[good], tops[i].keys)]
            tops[i].add(row[good], ids[good], keys[good])
            read[i] = n
    return read


def lists_of(block: Block) -> Lists:
    if "lists" not in block.kept:
        block.kept["lists"] = Lists(block)
    return block.kept["lists"]


NONE = -(2**63)
FOUND = "key bigint, query_id bigint, vec_id bigint, row bigint, score bigint"


def _asking(every: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The queries among the rows of each block, with the k-th score that each has in its own block."""

    def asked(blocks: Iterator[Block]) -> Iterator[Block]:
        for block in blocks:
            queries = block.asking(np.flatnonzero(block.ids % every == 0))
            if len(queries.ids):
                tops = [Top(k) for _ in queries.ids]
                search(lists_of(block), queries, tops)
                known = np.array([int(t.scores[-1]) if len(t.scores) == k else NONE for t in tops], "<i8")
                yield Block(queries.number, queries.ids, queries.labels, queries.cells, queries.extra + known.tobytes())

    return lambda batches: packed_batches(asked(unpacked(batches)))


def _answering(k: int) -> Callable[[list[Block], Block], Iterator[pa.RecordBatch]]:
    def answer(blocks: list[Block], queries: Block) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        tops = [Top(k, None if x == NONE else int(x)) for x in np.frombuffer(queries.more(), "<i8")]
        for block in blocks:
            search(lists_of(block), queries, tops)
        rows = (
            (int(key), int(query), int(vec), int(row), int(score))
            for key, query, top in zip(queries.own_keys(), queries.ids, tops, strict=True)
            for score, vec, row in zip(top.scores, top.ids, top.keys, strict=True)
        )
        yield from in_batches(rows, pa.schema([(c, pa.int64()) for c in ("key", "query_id", "vec_id", "row", "score")]))

    return answer


def top_products(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = 256) -> DataFrame:
    """The ``k`` rows with the largest inner product for each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; they meet every row but themselves. Components x
    count as floor(scale * x), scores are exact whole numbers. Equal scores are ranked by id. Rows without id, and
    vectors that are null or have a component that is null or not finite, take no part. Vectors of different length are
    never compared; an empty vector scores 0 with other empty ones. Rows that share an id are rows of their own: they meet
    each other, and if they are queries each has its own ranks. With fewer than k others all are returned; an
    empty table gives no rows. A score beyond 64 bits is an error. Other columns are not looked at.
    """
    blocks = packed(rows, id_col, vec_col, scale=scale)
    asked = settle(blocks.mapInArrow(_asking(every, k), PACKED), "vector-queries")
    found = meet(blocks, asked, slots_for(blocks), _answering(k), FOUND)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def whole_vectors_sql(columns: str) -> str:
    """DuckDB SQL for the vectors that take part, as ``v``."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT {columns}, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND {finite}"


OP12_SQL = f"""
WITH e AS ({whole_vectors_sql("vec_id")}),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0
),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5"""


@query("op12_threshold_topk", OP12_SQL)
def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
