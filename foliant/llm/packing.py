"""Order-preserving packing: windows of a token stream, cut where it costs least.

The documents of a partition form one token stream in their order. A dynamic programme chooses the cuts at document or
sentence ends so that padding plus penalties for cut documents is least; the best earlier cut within a window's reach
comes from a monotone queue, so the work is linear. Nothing is shuffled: every scan task packs its own stream.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import picked, query
from foliant.llm.lengths import vocabulary

if TYPE_CHECKING:
    import pyarrow as pa

WORDS = "word_bpe_49k.json"
WINDOW = 4096
DOC_END_ID = 2
SENTENCE_CUT = 16  # a cut between sentences counts as much as this many tokens of padding
HARD_CUT = 64  # a cut inside a long sentence
HARD_STEP = 64  # tokens between the places to cut inside a long sentence
BLOCK = 1 << 21  # tokens whose cuts are chosen together
CACHED_WORDS = 250_000  # encoded words that a task remembers
CLOSERS = "\"')]}»”’"
ENDS = (".", "!", "?", "…", "。")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def end_marked_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a BPE file with word ends, as ranks: the end of a word is a blank after it.

    In such a file a token's id is the rank of its merge. Merging by rank gives the tokenizer's ids if each token comes
    out of its own characters: a pair that makes a token while no earlier merge is left is then that token's own pair.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, bytes_of = content["model"], byte_of_char()
    special = {t["content"] for t in content["added_tokens"]}
    end = model["end_of_word_suffix"]
    ranks = {}
    for token, rank in model["vocab"].items():
        if token not in special:
            core = token.removesuffix(end) if len(token) > len(end) else token
            ranks[bytes(bytes_of[c] for c in core) + (b" " if core != token else b"")] = rank
    return ranks


class WordIds(dict):
    """Ids of blank-separated words, each encoded once.

    The tokenizer drops white space and never merges over it, so the ids of a text are those of its words in turn.
    Looking up an unknown word numbers it; ``encode_new`` encodes all such words in one call. Words of Latin letters are
    lower-cased and split here and merged by rank, which is several times faster; all others go through the tokenizer.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = end_marked_ranks(path)
        self.ranked = tiktoken.Encoding(path, pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.is_last = np.zeros(max(ranks.values()) + 1, bool)
        self.is_last[[rank for token, rank in ranks.items() if len(token) > 1 and token.endswith(b" ")]] = True
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.other = re.compile("[^\n!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f\u2013\u2014\u2018-\u201d\u2026]").search
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ends = np.empty(0, bool)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def _by_tokenizer(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.asarray(made.ids, np.uint32), np.bincount(np.asarray(made.word_ids, np.int64), minlength=len(words))

    def _by_rank(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        counts = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            if word.isalpha():
                pieces.append(word)
                counts[i] = 1
            else:
                found = self.split(word.lower())
                pieces += found
                counts[i] = len(found)
        if not pieces:
            return np.empty(0, np.uint32), np.zeros(len(words), np.int64)
        ids = np.asarray(self.ranked.encode_ordinary(" ".join(pieces).lower() + " "), np.uint32)
        tokens_before = np.concatenate([[0], np.flatnonzero(self.is_last[ids]) + 1])  # by piece
        pieces_before = np.concatenate([[0], np.cumsum(counts)])  # by word
        return ids, np.diff(tokens_before[pieces_before])

    def encode_new(self) -> None:
        if not self.new:
            return
        new, self.new = self.new, []
        other = np.fromiter((self.other(w) is not None for w in new), bool, len(new))
        size = np.zeros(len(new), np.int64)
        begin = np.zeros(len(new), np.int64)
        for chosen, encode in ((np.flatnonzero(other), self._by_tokenizer), (np.flatnonzero(~other), self._by_rank)):
            if len(chosen):
                ids, size[chosen] = encode([new[i] for i in chosen])
                begin[chosen] = len(self.ids) + np.cumsum(size[chosen]) - size[chosen]
                self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, begin])
        self.size = np.concatenate([self.size, size])
        self.ends = np.concatenate([self.ends, np.fromiter((w[-1:] == "\n" or w.rstrip(CLOSERS).endswith(ENDS) for w in new), bool, len(new))])

    def numbered(self, text: str) -> np.ndarray:
        words = text.replace("\n", "\n ").split(" ")  # a line end stays with its word and ends a sentence
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def document(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a document and the places after which a sentence ends."""
        size = self.size[words]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        at = np.repeat(self.begin[words] - (after - size), size) + np.arange(total)
        return self.ids[at], after[self.ends[words]]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int, free_last: bool = False) -> list[int]:
    """Indices of the chosen cuts among ``places``, which begin with 0 and lie at most ``window`` apart.

    Least sum over windows of unused tokens and the penalty of the cut at its end; of equal choices the one with the
    earlier previous cut is taken. With ``free_last`` the last window's unused tokens do not count.
    """
    at, fine = places.tolist(), penalties.tolist()
    came = [0] * len(at)
    costs = [0] * len(at)
    queue = deque([(0, at[0], 0)])  # (cost so far + place, place, index), costs rising
    for j in range(1, len(at)):
        here = at[j]
        while here - queue[0][1] > window:
            queue.popleft()
        best, _, came[j] = queue[0]
        costs[j] = cost = best + window + fine[j]  # minus here, plus here again as a start
        while queue and queue[-1][0] > cost:
            queue.pop()
        queue.append((cost, here, j))
    if free_last and len(at) > 1:
        near = range(bisect_left(at, at[-1] - window), len(at) - 1)
        came[-1] = min(near, key=lambda i: costs[i] - at[i])
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


class Piece(NamedTuple):
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int
    sequence: int
    offset: int


class Stream:
    """The token stream of one partition; ``emit`` hands out whole windows and keeps the last, open one."""

    def __init__(self, window: int, sentence_cut: int, hard_cut: int, block: int):
        self.window, self.sentence_cut, self.hard_cut, self.block = window, sentence_cut, hard_cut, block
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # document, its place in the stream, its tokens
        self.places: list[np.ndarray] = []
        self.penalties: list[np.ndarray] = []
        self.begin = self.end = self.sequences = 0

    def add(self, doc: object, ids: np.ndarray, sentence_ends: np.ndarray) -> Iterator[Piece]:
        ids = np.append(ids, np.uint32(DOC_END_ID))
        inner = np.unique(sentence_ends[(sentence_ends > 0) & (sentence_ends < len(ids) - 1)])
        places = np.append(inner, len(ids))
        penalties = np.full(len(places), self.sentence_cut, np.int64)
        penalties[-1] = 0
        # Sentences much longer than a step have places to cut inside, which cost more.
        step = max(1, min(HARD_STEP, self.window // 4))
        gaps = np.diff(places, prepend=0)
        more = np.where(gaps > 2 * step, (gaps - 1) // step, 0)
        if more.any():
            of = np.repeat(np.arange(len(places)), more)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + 1
            places = np.concatenate([places, (places - gaps)[of] + nth * step])
            penalties = np.concatenate([penalties, np.full(len(of), self.hard_cut)])
            order = np.argsort(places, kind="stable")
            places, penalties = places[order], penalties[order]
        self.docs.append((doc, self.end, len(ids)))
        self.parts.append(ids)
        self.places.append(places + self.end)
        self.penalties.append(penalties)
        self.end += len(ids)
        if self.end - self.begin >= self.block:
            yield from self.emit(last=False)

    def emit(self, last: bool) -> Iterator[Piece]:
        if self.end == self.begin:
            return
        ids = np.concatenate(self.parts)
        places = np.concatenate([[self.begin], *self.places])
        penalties = np.concatenate([[0], *self.penalties])
        cuts = best_cuts(places - self.begin, penalties, self.window, free_last=True)
        bounds = [self.begin, *places[cuts].tolist()]
        windows = list(zip(bounds, bounds[1:], strict=False))
        if last:  # the rest of a stream becomes sequences of powers of two, which need no padding
            begin, end = windows.pop()
            while begin < end:
                size = min(self.window, 1 << (end - begin).bit_length() - 1)
                windows.append((begin, begin + size))
                begin += size
        else:
            windows.pop()
        starts = [d[1] for d in self.docs]
        k = 0
        for begin, end in windows:
            at = begin
            while at < end:
                while starts[k] + self.docs[k][2] <= at:
                    k += 1
                doc, start, tokens = self.docs[k]
                to = min(end, start + tokens)
                yield Piece(doc, at - start, ids[at - self.begin : to - self.begin], tokens, self.sequences, at - begin)
                at = to
            self.sequences += 1
        done = windows[-1][1] if windows else self.begin
        keep = places > done
        self.parts, self.places, self.penalties = [ids[done - self.begin :]], [places[keep]], [penalties[keep]]
        self.docs = [d for d in self.docs if d[1] + d[2] > done]
        self.begin = done


def _packing(path: str, window: int, sentence_cut: int, hard_cut: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        words = _word_ids(path)
        stream = Stream(window, sentence_cut, hard_cut, block)
        number = pa.int64()

        def batch(pieces: list[Piece], kind: pa.DataType) -> pa.RecordBatch:
            columns = [
                pa.array([p.doc for p in pieces], kind),
                pa.array([p.start for p in pieces], number),
                pa.array([len(p.ids) for p in pieces], number),
                pa.array([p.ids.astype("<u4").tobytes() for p in pieces], pa.binary()),
                pa.array([p.doc_tokens for p in pieces], number),
                pa.array([base + p.sequence for p in pieces], number),
                pa.array([p.offset for p in pieces], number),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kind, held = None, []
        for b in batches:
            kind = b.column("doc_id").type
            for begin in range(0, b.num_rows, 1000):
                part = b.slice(begin, 1000)
                if len(words) > CACHED_WORDS:
                    words.clear_all()
                numbered = [words.numbered(t.as_py() or "") for t in part.column("text")]
                words.encode_new()
                for doc, numbers in zip(part.column("doc_id").to_pylist(), numbered, strict=True):
                    for piece in stream.add(doc, *words.document(numbers)):
                        held.append(piece)
                        if len(held) >= 4096:
                            yield batch(held, kind)
                            held = []
        words.clear_all()  # the worker goes on to other tasks
        for piece in stream.emit(last=True):
            held.append(piece)
            if len(held) >= 4096:
                yield batch(held, kind)
                held = []
        if held:
            yield batch(held, kind)

    return pack


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    window: int = WINDOW,
    sentence_cut: int = SENTENCE_CUT,
    hard_cut: int = HARD_CUT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are its ids and the end id. Each lies in exactly one piece; pieces of a sequence follow one
    another from offset 0 in the order of the documents in their partition. Sequences hold at most ``window`` tokens.
    Null and empty texts hold the end id alone; a null doc_id is kept as it is, and rows that repeat an id are
    documents of their own. Cuts are chosen over ``block`` tokens at a time, which bounds memory; the open window at a block's
    end goes on into the next. The last window of a partition is cut into sequences of powers of two.
    """
    slim = picked(docs, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return slim.mapInArrow(_packing(path or vocabulary(WORDS), window, sentence_cut, hard_cut, block), rows)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_pack_documents")
def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(table(spark, sf_dir, "documents")))
