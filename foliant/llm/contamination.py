"""Benchmark decontamination by edit distance with pigeonhole pieces.

A test item with an error budget of e edits is cut into e + 1 pieces: a passage within the budget leaves one piece
untouched. One automaton finds all pieces of a block of items in a text; each hit is verified with Myers' bit-parallel
edit distance. Items too short for edits are looked for as they are, at word boundaries. Documents are only scanned, never shuffled; hits are aggregated per document and item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from foliant.catalog.base import table
from foliant.llm.base import in_batches, lean, picked, query, texts_of
from foliant.llm.toxicity import words_of
from foliant.plans.sizing import written

if TYPE_CHECKING:
    import pyarrow as pa

ERROR_RATE = 0.05  # edits allowed per character of an item
LEAST_CHARS = 24  # items below this match without edits, and only as whole words
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20


def normalised(text: bytes) -> str:
    """Words with A-Z lower-cased and ASCII punctuation left out, one blank between them; one character per byte."""
    return b" ".join(words_of(text)).decode("latin-1")


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their places."""
    n = budget + 1
    bounds = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where the first best part ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The items of one block and the automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float, least_chars: int = LEAST_CHARS):
        import ahocorasick

        self.items = items
        self.budgets = [int(rate * len(text)) if len(text) >= least_chars else 0 for _, text in items]
        self.short = [len(text) < least_chars for _, text in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for at, piece in pieces_of(text, self.budgets[i]):
                owners.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owned in owners.items():
            self.automaton.add_word(piece, (len(piece), owned))
        if owners:
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Best match by item: distance, start and end of the verified stretch in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        if not self.items:
            return best
        for last, (size, owned) in self.automaton.iter(text):
            for i, at in owned:
                item, budget = self.items[i][1], self.budgets[i]
                start = last + 1 - size - at
                if self.short[i]:
                    if text[max(start - 1, 0) : start].strip() or text[last + 1 : last + 2].strip():
                        continue  # inside a longer word
                    best.setdefault(i, (0, start, last + 1))
                    continue
                if start >= 0 and text.startswith(item, start):
                    if i not in best or best[i][0] > 0:
                        best[i] = (0, start, start + len(item))
                    continue
                if i in best and best[i][0] == 0:
                    continue
                lo, hi = max(0, start - budget), min(len(text), start + len(item) + budget)
                if hi - lo < len(item) - budget or any(a <= lo and hi <= b for a, b in tried.get(i, ())):
                    continue
                tried.setdefault(i, []).append((lo, hi))
                distance, end = myers(item, text[lo:hi])
                if distance <= budget and (i not in best or distance < best[i][0]):
                    best[i] = (distance, lo, lo + end)
        return best


def _matching(items: list[tuple[object, str]], item_kind: pa.DataType, rate: float, least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        matcher = Matcher(items, rate, least_chars)

        def rows() -> Iterator[tuple]:
            for b in [first] if first else []:
                yield from of(b)
            for b in batches:
                yield from of(b)

        def of(b: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(b.column("doc_id"), texts_of(b.column("text")), strict=True):
                for i, (distance, start, end) in matcher.found(normalised(text)).items():
                    yield doc.as_py(), items[i][0], distance, start, end, matcher.budgets[i]

        first = next(batches, None)
        if first is None:
            return
        number = pa.int64()
        schema = pa.schema(
            [("doc_id", first.column("doc_id").type), ("item_id", item_kind), ("distance", number), ("start", number), ("end", number), ("budget", number)]
        )
        yield from in_batches(rows(), schema)

    return match


def item_blocks(items: DataFrame, id_col: str, text_col: str, least_chars: int = 0) -> Iterator[list[tuple[object, str]]]:
    """The normalised items in blocks of bounded rows and bytes; one block is held at a time.

    ``least_chars`` leaves out shorter items; by default none are.
    """
    block: list[tuple[object, str]] = []
    size = 0
    for row in picked(items, item_id=id_col, text=text_col).orderBy("item_id", "text").toLocalIterator():
        text = normalised((row["text"] or "").encode())
        if not text or len(text) < least_chars or row["item_id"] is None:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, distance, start, end, budget.

    Both texts are normalised first (A-Z lower-cased, ASCII punctuation and white space one blank); distance, budget,
    start and end count bytes of the normalised texts. An item matches if some part of the document is within ``rate`` edits per
    character of it. An item shorter than ``least_chars`` matches without edits and at word boundaries. Items without id, and
    null items or those without words, match nothing, nor do null and empty documents. Whole texts are searched, however long. Repeated items under other ids match each by themselves, repeated documents too. The items
    are the query set: they go to the tasks in blocks of bounded size, with one scan of the documents for each block.
    """
    slim = picked(docs, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = picked(items, item_id=item_col).schema["item_id"].dataType
    rows = f"doc_id {kind}, item_id {item_kind.simpleString()}, distance bigint, start bigint, end bigint, budget bigint"
    found: DataFrame | None = None
    for block in item_blocks(items, item_col, item_text_col):
        part = slim.mapInArrow(_matching(block, to_arrow_type(item_kind), rate, least_chars), rows)
        if len(block) >= BLOCK_ITEMS // 2:
            part = written(part, "contaminated")  # the driver then holds one block at a time
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], rows) if found is None else found


def _keeping(items: list[tuple[object, str]], rate: float, least_chars: int, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        matcher = Matcher(items, rate, least_chars)
        for batch in batches:
            clean = [not matcher.found(normalised(t)) for t in texts_of(batch.column(text_col))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    least_chars: int = LEAST_CHARS,
) -> DataFrame:
    """The whole rows of the documents in which ``contaminated`` finds no item, in one pass for each block of items.

    Null and empty texts stay, repeated rows stay or go together, and no column is added, so any other columns may be there. With no items or no
    documents the rows are those that came.
    """
    for block in item_blocks(items, item_col, item_text_col):
        docs = docs.mapInArrow(lean(_keeping(block, rate, least_chars, text_col)), docs.schema)
        if len(block) >= BLOCK_ITEMS // 2:
            docs = written(docs, "clean")  # the driver then holds one block at a time
    return docs


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
