"""Ranked lexical search of many queries at once, with common subexpressions evaluated once.

The score of a document for an item is a sum over the item's terms, so terms that several items share can be added up
once. Items are mined for shared sets: terms that stand in exactly the same items become one leaf, then the pair of parts
that most items have in common becomes a new part, again and again, until no pair is shared. The parts form a directed
acyclic graph whose sinks are the items. A task turns its documents into accumulators of the leaves, adds up each shared
part once, and combines parts to items; it keeps only its best rows of each item.

Documents are tokenized once into a narrow table (counts of the items' terms); texts are never shuffled. Items are
the query set: they go to the tasks in blocks whose mining and memory are bounded.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.catalog.base import table
from foliant.llm.base import LOWER, UPPER, in_batches, picked, query, texts_of
from foliant.llm.repeats import settle
from foliant.plans.sizing import spread

if TYPE_CHECKING:
    import pyarrow as pa

K = 20
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 8 << 20
BLOCK_PAIRS = 4_000_000  # pairs of terms that mining may have to look at
CELLS = 4 << 20  # accumulators held at a time

#: Letters, digits and everything above ASCII belong to terms, the rest parts them; A-Z are lower-cased.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


@dataclass(frozen=True)
class Sharing:
    """How a block of items is added up.

    ``terms`` numbers the terms. Leaf ``leaf_of[j]`` takes ``times_of[j]`` times the share of term ``term_of[j]``. Part
    ``leaves + i`` is the sum of the two parts ``sums[i]``. Item i is the sum of the parts ``items[i]``.
    """

    terms: dict[bytes, int]
    term_of: np.ndarray
    leaf_of: np.ndarray
    times_of: np.ndarray
    leaves: int
    sums: list[tuple[int, int]]
    items: list[list[int]]

    @property
    def parts(self) -> int:
        return self.leaves + len(self.sums)


def share(texts: list[list[bytes]]) -> Sharing:
    """Mine the items of a block, given as their terms, for shared sets."""
    holders: dict[tuple[bytes, int], list[int]] = defaultdict(list)
    for i, words in enumerate(texts):
        for symbol in sorted(Counter(words).items()):
            holders[symbol].append(i)
    terms = {w: j for j, w in enumerate(sorted({w for w, _ in holders}))}
    leaf_at: dict[tuple[int, ...], int] = {}
    cells = sorted((terms[w], leaf_at.setdefault(tuple(at), len(leaf_at)), times) for (w, times), at in holders.items())
    items: list[set[int]] = [set() for _ in texts]
    for at, leaf in leaf_at.items():
        for i in at:
            items[i].add(leaf)

    # Which items hold both parts of a pair; a part that only one item holds is never shared.
    pairs: dict[tuple[int, int], set[int]] = defaultdict(set)
    count = Counter(p for parts in items for p in parts)

    def meet(part: int, others: list[int], item: int) -> None:
        for other in others:
            pairs[min(part, other), max(part, other)].add(item)

    for i, parts in enumerate(items):
        often = sorted(p for p in parts if count[p] > 1)
        for n, part in enumerate(often):
            meet(part, often[n + 1 :], i)
    queue = [(-len(at), pair) for pair, at in pairs.items() if len(at) > 1]
    heapq.heapify(queue)
    sums: list[tuple[int, int]] = []
    while queue:
        n, pair = heapq.heappop(queue)
        at = pairs[pair]
        if len(at) != -n:
            if len(at) > 1:
                heapq.heappush(queue, (-len(at), pair))
            continue
        new = len(leaf_at) + len(sums)
        sums.append(pair)
        grown: set[tuple[int, int]] = set()
        for i in sorted(at):
            items[i] -= set(pair)
            for other in items[i]:
                for old in pair:
                    pairs[min(old, other), max(old, other)].discard(i)
                if count[other] > 1:
                    pairs[other, new].add(i)
                    grown.add((other, new))
            items[i].add(new)
        pairs.pop(pair)
        count[new] = -n
        for p in grown:
            if len(pairs[p]) > 1:
                heapq.heappush(queue, (-len(pairs[p]), p))
    columns = np.array(cells, np.int64).reshape(-1, 3).T
    return Sharing(terms, columns[0], columns[1], columns[2], len(leaf_at), sums, [sorted(x) for x in items])


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their terms, in blocks of bounded rows, bytes and pairs of different terms; one is held at a time."""
    block: list[tuple[object, list[bytes]]] = []
    size = pairs = 0
    for row in picked(items, item_id=id_col, text=text_col).orderBy("item_id", "text").toLocalIterator():
        words = terms_of((row["text"] or "").encode())
        if not words:
            continue
        more, wide = sum(map(len, words)), len(set(words)) ** 2 // 2
        if block and (len(block) >= BLOCK_ITEMS or size + more > BLOCK_BYTES or pairs + wide > BLOCK_PAIRS):
            yield block
            block, size, pairs = [], 0, 0
        block.append((row["item_id"], words))
        size += more
        pairs += wide
    if block:
        yield block


def _counting(terms: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to their length in terms and their counts of the items' terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column("doc_id"), texts_of(batch.column("text")), strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    held = Counter(words)
                    found = sorted((terms[w], held[w]) for w in held.keys() & terms.keys())
                    at = np.array(found, np.int64).reshape(-1, 2)
                    yield doc.as_py(), len(words), at[:, 0].astype(np.int32).tobytes(), at[:, 1].astype(np.int32).tobytes()

        yield from in_batches(rows(), pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("tf", pa.binary())]), 4_000)

    return count


def _holding(n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many of a task's documents hold each term."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column("at").to_pylist()), np.int32)
            total += np.bincount(at, minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    return hold


class Best:
    """The best ``k`` documents of each item so far: highest score first, then least doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_items
        self.least = np.ones(n_items, np.int64)  # only scores above 0 count

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: a row for each item, a column for each document."""
        hits = scores >= self.least[:, None]
        for i in np.flatnonzero(hits.any(axis=1)):
            new = np.flatnonzero(hits[i])
            s, d = np.concatenate([self.held[i][0], scores[i, new]]), np.concatenate([self.held[i][1], docs[new]])
            best = np.lexsort((d, -s))[: self.k]
            self.held[i] = s[best], d[best]
            if len(best) == self.k:
                self.least[i] = s[best[-1]]


def _scoring(sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        best = Best(len(sharing.items), k)
        step = max(16, CELLS // max(1, sharing.parts + len(sharing.items)))
        # The leaves that take a term: a stretch of the cells, which are in order of their term.
        first = np.searchsorted(sharing.term_of, np.arange(len(sharing.terms) + 1))
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                docs, n = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
                at = [np.frombuffer(x, np.int32) for x in part.column("at").to_pylist()]
                term = np.concatenate(at).astype(np.int64)
                doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
                tf = np.frombuffer(b"".join(part.column("tf").to_pylist()), np.int32).astype(np.int64)
                m = 75 + (25 * n * n_docs) // n_terms
                shares = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                times = first[term + 1] - first[term]
                cell = np.repeat(first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                held = np.zeros((sharing.parts, len(docs)), np.int64)
                np.add.at(held, (sharing.leaf_of[cell], np.repeat(doc, times)), sharing.times_of[cell] * np.repeat(shares, times))
                for i, (a, b) in enumerate(sharing.sums, sharing.leaves):
                    np.add(held[a], held[b], out=held[i])
                best.add(np.stack([held[parts].sum(axis=0) for parts in sharing.items]), docs)
        found = [(i, int(d), int(s)) for i, (scores, ids) in enumerate(best.held) for s, d in zip(scores, ids, strict=True)]
        yield from in_batches(found, pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return score


def _search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], item_kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    sharing = share([words for _, words in block])
    counted = settle(docs.mapInArrow(_counting(sharing.terms), "doc_id bigint, n bigint, at binary, tf binary"), "lexical-counts")
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    # At most as many rows as the block has different terms.
    held = counted.mapInArrow(_holding(len(sharing.terms)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(sharing.terms), np.int64)
    for row in held:
        weights[row["term"]] = math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * row["df"] + 1)))
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {item_kind}")
    found = counted.mapInArrow(_scoring(sharing, weights, totals["docs"], totals["terms"] or 1, k), "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: a block of items at most


def search_shared(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters above ASCII, A-Z lower-cased. With N documents that have a term, L
    terms in them, n in a document and a term in df documents, its weight is floor(1000 ln((2N + 2) / (2 df + 1))), the
    document's m is 75 + 25 n N div L, and tf occurrences score weight * (10^9 tf div (1000 tf + 12 m)). A term that an item
    repeats counts as often. Equal scores are ranked by doc_id.

    Whole texts count, however long. Null and empty texts have no terms: such documents count nowhere, and such items have no
    rows. Repeated documents and items are ranked each by themselves. A document without id counts in N, L and df but
    cannot be named, so it has no rank; items without id keep their null. With no documents or no items there are no rows.
    Other columns of either table are not looked at.
    """
    slim = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if slim._jdf.rdd().getNumPartitions() < docs.sparkSession.sparkContext.defaultParallelism:
        slim = spread(slim)  # else the scan's own splits keep all cores busy
    kind = picked(items, item_id=item_col).schema["item_id"].dataType.simpleString()
    found: DataFrame | None = None
    for block in item_blocks(items, item_col, item_text_col):
        part = settle(_search_block(slim, block, kind, k), "lexical-best")
        found = part if found is None else found.unionByName(part)
    empty = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    return docs.sparkSession.createDataFrame([], empty) if found is None else found


_TERMS_SQL = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS words FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY doc_id, term),
s AS (SELECT count(*) AS big_n, CAST(sum(len(words)) AS BIGINT) AS big_l FROM d WHERE len(words) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS share FROM tf JOIN w USING (term), s),
q AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE text IS NOT NULL),
r AS (SELECT item_id, doc_id, CAST(sum(share) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY item_id, doc_id HAVING sum(share) > 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""


@query("op11_shared_terms", OP11_SQL)
def op11_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_shared(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
