"""Repeated passages of words by recompression.

Every text is compressed bottom-up in rounds: first runs of one symbol, then pairs whose left symbol fell to the left
half and right symbol to the right half of the alphabet, get a name of their own. Names and halves are digests of what
they stand for, so all tasks give equal runs and pairs equal names without exchanging a dictionary, and equal passages
have the same symbols inside. Only near the ends of a passage do symbols depend on what lies outside. Each symbol
carries the stretch of words that it depends on; a window of words *shows* a symbol if it holds that whole stretch, and
so equal windows show equal symbols at equal places. Of the symbols of the last round that a window shows, the one with
the least hash is its pivot (windows that show none fall back to a word).

Spark then works on pivots: neighbouring windows with one pivot are a row, named by the pivot's stretch; rows with a
shared name are verified by the digest of all their words, and where they differ, window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import query
from foliant.llm.repeats import chunks, forget, settle, tagged, with_lists

if TYPE_CHECKING:
    import pyarrow as pa

WIDTH = 50
ROUNDS = 4
LONGEST = 16  # words that a pair may stand for at most; runs may be longer
POSITION = 24  # bits of a place inside a chunk
SEGMENT = 1 << 20  # words; longer texts are cut into segments that overlap by a window
WORDS_KEPT = 1 << 18  # word digests that a worker remembers

_random = np.random.default_rng(20_012)
_ODD = _random.integers(0, 1 << 63, 2 * ROUNDS + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.uint64((1 << POSITION) - 1)
_FAR = 1 << 40


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """64-bit digest of each word under a seed, made once."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        made = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return made


_names, _checks = WordHashes(0), WordHashes(20_015)


def hashed_words(text: bytes, known: WordHashes = _names) -> np.ndarray:
    """Digests of the words of a text; words are parted by ASCII white space."""
    if len(known) > WORDS_KEPT:
        known.clear()
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def named_and_checked(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each word that have nothing to do with each other."""
    return hashed_words(text), hashed_words(text, _checks)


class Symbols:
    """The symbols of some texts after a number of rounds, with the words they stand for and depend on."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        at = np.arange(len(words))
        self.name, self.owner = words, owner
        self.start, self.end = at, at + 1
        self.low, self.high = at, at + 1

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol has a left, and a right, neighbour in its text."""
        same = self.owner[1:] == self.owner[:-1]
        return np.concatenate([[False], same]), np.concatenate([same, [False]])

    def name_runs(self, odd: np.uint64) -> None:
        """A maximal run of one symbol becomes one symbol; even a lone symbol depends on both neighbours being others."""
        has_left, has_right = self._edges()
        low = np.where(has_left, np.concatenate([[0], self.low[:-1]]), -_FAR)
        high = np.where(has_right, np.concatenate([self.high[1:], [0]]), _FAR)
        head = ~has_left
        head[1:] |= self.name[1:] != self.name[:-1]
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(head)) - 1
        count = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        self.name = np.where(count > 1, mixed(name * odd + count), name)
        self.owner = self.owner[first]
        self.start, self.end = self.start[first], self.end[last]
        self.low, self.high = np.minimum(self.low[first], low[first]), np.maximum(self.high[last], high[last])

    def name_pairs(self, odd: np.uint64) -> None:
        """A symbol of the left half and a following one of the right half become one symbol."""
        has_left, has_right = self._edges()
        left = (mixed(self.name ^ odd) & np.uint64(1)).astype(bool)
        size = self.end - self.start
        pair = np.zeros(len(left), bool)
        pair[:-1] = left[:-1] & ~left[1:] & has_right[:-1] & (size[:-1] + size[1:] <= LONGEST)
        # A left symbol looks at its right neighbour, a right one at its left neighbour.
        far_low, far_high = np.full(len(left), -_FAR), np.full(len(left), _FAR)
        after_high = np.where(has_right, np.concatenate([self.high[1:], [0]]), far_high)
        before_low = np.where(has_left, np.concatenate([[0], self.low[:-1]]), far_low)
        low = np.where(left, self.low, np.minimum(self.low, before_low))
        high = np.where(left, np.maximum(self.high, after_high), self.high)
        keep = np.ones(len(left), bool)
        keep[1:] = ~pair[:-1]
        joined = np.flatnonzero(pair)
        name, end = self.name.copy(), self.end.copy()
        name[joined] = mixed(mixed(self.name[joined]) * odd + self.name[joined + 1])
        end[joined] = self.end[joined + 1]
        low[joined], high[joined] = self.low[joined], self.high[joined + 1]
        low[joined] = np.minimum(low[joined], self.low[joined + 1])
        high[joined] = np.maximum(high[joined], self.high[joined])
        self.name, self.owner, self.start, self.end = name[keep], self.owner[keep], self.start[keep], end[keep]
        self.low, self.high = low[keep], high[keep]


def compressed(words: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    symbols = Symbols(words, owner)
    for r in range(rounds):
        symbols.name_runs(_ODD[2 * r])
        symbols.name_pairs(_ODD[2 * r + 1])
    return symbols


class Stretches:
    """Digests of any stretch of words, from prefix sums of a polynomial."""

    def __init__(self, words: np.ndarray, lane: int):
        base = int(_ODD[2 * ROUNDS + lane])
        inverse = pow(base, -1, 1 << 64)
        n = len(words)
        self.back = self._powers(inverse, n + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words + np.uint64(lane)) * self._powers(base, n), dtype=np.uint64)])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)[:n]

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(sums + (end - start).astype(np.uint64))


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first .. last] for each pair, both included and not empty."""
    rows = [values]
    size = 1
    longest = int((last - first).max(initial=0)) + 1
    while size * 2 <= longest:
        row = rows[-1].copy()
        row[: len(row) - size] = np.minimum(row[: len(row) - size], row[size:])
        rows.append(row)
        size *= 2
    levels = np.stack(rows)
    power = np.zeros(longest + 1, np.int64)
    power[1:] = np.log2(np.arange(1, longest + 1)).astype(np.int64)
    k = power[last - first + 1]
    return np.minimum(levels[k, first], levels[k, last - (1 << k) + 1])


def runs_of(words: np.ndarray, checks: np.ndarray, sizes: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one pivot: text number, start in the text, windows, pivot name, digest of the run.

    The pivot is named after ``words``, the run digested from ``checks``.
    """
    n = len(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(max(n - width + 1, 0))
    at = at[at + width <= (begins + sizes)[owner[at]]]
    empty = np.empty(0, np.int64)
    if not len(at):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    symbols = compressed(words, owner, rounds)
    # A window at p shows the symbols with p <= low and high <= p + width. Both bounds rise along the text.
    low, high = np.maximum(symbols.low, -1), np.minimum(symbols.high, n + width)
    low = np.maximum.accumulate(np.where(symbols.low < 0, -1, low))
    first = np.searchsorted(low, at, "left")
    last = np.searchsorted(np.minimum.accumulate(high[::-1])[::-1], at + width, "right") - 1
    shows = (first <= last) & (first < len(low))
    order = np.arange(len(low), dtype=np.uint64)
    keys = mixed(symbols.name ^ _ODD[-1]) & ~_MASK | order
    pivot = np.full(len(at), -1, np.int64)
    if shows.any():
        pivot[shows] = (_least_between(keys, first[shows], last[shows]) & _MASK).astype(np.int64)
    plain = ~shows
    if plain.any():
        word_keys = mixed(words ^ _ODD[-2]) & ~_MASK | np.arange(n, dtype=np.uint64)
        place = _least_between(word_keys, at[plain], at[plain] + width - 1) & _MASK
        pivot[plain] = place.astype(np.int64) + len(low)
    changes = np.ones(len(at), bool)
    changes[1:] = (pivot[1:] != pivot[:-1]) | (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(changes)
    count = np.append(head[1:], len(at)) - head
    start, pivot = at[head], pivot[head]
    lane = Stretches(words, 0)
    shown = pivot < len(low)
    of_symbol = np.minimum(pivot, len(low) - 1)
    of_word = np.maximum(pivot - len(low), 0)
    name = mixed(words[np.minimum(of_word, n - 1)] ^ _ODD[-3])
    k = of_symbol[shown]
    # The pivot is named by its symbol and all the words the symbol depends on, which every window of the run holds.
    name[shown] = mixed(symbols.name[k] ^ lane.digest(symbols.low[k], symbols.high[k]))
    whole = Stretches(checks, 1).digest(start, start + count + width - 1)
    return owner[start], start - begins[owner[start]], count, name, whole


def _parts(texts: list[bytes], width: int) -> Iterator[tuple[list[int], list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Word digests of texts, the long ones cut into overlapping segments, in groups of bounded size."""
    numbers: list[int] = []
    offsets: list[int] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        words, checks = named_and_checked(text)
        for begin in range(0, max(len(words) - width + 1, 1), SEGMENT):
            here = slice(begin, begin + SEGMENT + width - 1)
            part = words[here], checks[here]
            if size + len(part[0]) >= 1 << POSITION - 1:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(i)
            offsets.append(begin)
            parts.append(part)
            size += len(part[0])
    if parts:
        yield numbers, offsets, parts


def _naming(width: int, rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for rows, texts, batch in chunks(batches):
            for numbers, offsets, parts in _parts(texts, width):
                words, checks = (np.concatenate(x) for x in zip(*parts, strict=True))
                sizes = np.fromiter((len(x) for x, _ in parts), np.int64, len(parts))
                number, start, count, pivot, whole = runs_of(words, checks, sizes, width, rounds)
                if not len(number):
                    continue
                take = pa.array(np.asarray(rows)[np.asarray(numbers)[number]])
                place = start + np.asarray(offsets, np.int64)[number] << 24 | count
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(place), pa.array(pivot.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["doc_id", "tag", "place", "pivot", "whole"],
                )

    return name


def _opening(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                both = named_and_checked(batch.column("text")[i].as_buffer().to_pybytes())
                packed = batch.column("found")[i].values.to_numpy(zero_copy_only=False)
                place, undecided = packed >> 1, packed & 1
                count = place & 0xFFFFFF
                at = np.repeat((place >> 24) - (np.cumsum(count) - count), count) + np.arange(count.sum())
                one, two = (Stretches(x, lane).digest(at, at + width) for x, lane in zip(both, (2, 3), strict=True))
                take = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(take),
                        batch.column("tag").take(take),
                        pa.array(at),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array(np.repeat(undecided, count).astype(bool)),
                    ],
                    ["doc_id", "tag", "window", "one", "two", "undecided"],
                )

    return open_windows


def later_stretches(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, tag, stretch): stretches of windows, start << 32 | end in words, that an earlier document holds too.

    ``docs`` are rows of ``tagged``.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    later = lambda than: F.expr(f"doc_id > {than} OR (doc_id IS NULL AND {than} IS NOT NULL)")
    rows = f"doc_id {kind}, tag bigint, place bigint, pivot bigint, whole bigint"
    runs = settle(docs.mapInArrow(_naming(width, rounds), rows), "passage-runs")

    # Pivots of one document alone are settled: no earlier document holds their windows.
    # Small sides are written before they are joined: then both sides of each join are plain exchanges, and Spark can
    # split the partitions of hot pivots.
    pivots = settle(
        runs.groupBy("pivot")
        .agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"))
        .where("lowest IS NOT NULL AND (lowest < highest OR known < n)")
        .select("pivot", "lowest"),
        "passage-pivots",
    )
    shared = settle(runs.join(pivots, "pivot"), "passage-shared")
    forget(spark, runs, pivots)

    # Equal runs: the verified repeats. Only the first document's rows may still hold windows of other runs.
    wholes = settle(shared.groupBy("pivot", "whole").agg(F.min("doc_id").alias("first")), "passage-wholes")
    checked = shared.join(wholes, ["pivot", "whole"])
    equal = checked.where(later("first")).select(
        "doc_id", "tag", F.expr(f"shiftleft(shiftrightunsigned(place, 24), 32) | (shiftrightunsigned(place, 24) + (place & 16777215) + {width - 1})").alias("stretch")
    )
    kinds = settle(wholes.groupBy("pivot").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("pivot"), "passage-kinds")
    opened = (
        checked.where(F.expr("doc_id <=> first"))
        .join(kinds, "pivot")
        .select("doc_id", "tag", (F.shiftleft("place", 1) + F.when(later("lowest"), 1).otherwise(0)).alias("packed"))
    )
    window_rows = f"doc_id {kind}, tag bigint, window bigint, one bigint, two bigint, undecided boolean"
    windows = settle(with_lists(docs, opened, "packed", "inner").mapInArrow(_opening(width), window_rows), "passage-windows")
    firsts = windows.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settle(firsts.where("n > 1 AND first IS NOT NULL").select("one", "two", "first"), "passage-firsts")
    single = (
        windows.where("undecided")
        .join(firsts, ["one", "two"])
        .where(later("first"))
        .select("doc_id", "tag", F.expr(f"shiftleft(window, 32) | (window + {width})").alias("stretch"))
    )
    found = settle(equal.unionByName(single), "passage-stretches")
    forget(spark, shared, wholes, kinds, windows, firsts)
    return found


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    for batch in batches:
        numbers, removed, kept = [], [], []
        for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found"), strict=True):
            words = text.as_py().split()
            parts: list[bytes] = []
            at = 0
            for packed in sorted(found.as_py() or ()):
                low, high = packed >> 32, packed & 0xFFFFFFFF
                if low > at:
                    parts += words[at:low]
                at = max(at, high)
            parts += words[at:]
            numbers.append(len(words))
            removed.append(len(words) - len(parts))
            kept.append(b" ".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def without_later_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that are left, one blank between them).

    A word is removed if it lies in a window of ``width`` words that also starts in a document with a smaller doc_id;
    windows are judged on the texts as they came, so the first document keeps the passage. Words are parted by ASCII
    white space and compared unchanged. Null and empty texts have no words; texts shorter than ``width`` are kept whole.
    A document without id comes after all with one, and removes nothing. Rows with equal ids do not remove each other's
    words.
    """
    texts = tagged(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary"
    return with_lists(texts, later_stretches(texts, width, rounds), "stretch", "left").mapInArrow(_removing, rows)


@query("op10_recompression_dedup")
def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_later_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
