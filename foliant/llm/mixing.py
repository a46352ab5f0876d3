"""Scores of texts by logistic mixing of hashed-context bit predictors.

A text is a sequence of words and an end; each is spelled with a blank after it, and every bit of it is predicted, whether the
training texts hold the word or not. Contexts are the last 1 to 4 bytes, which reach into the word before, and the word so
far, each with the bits of the byte so far; zeros and ones are counted over all tokens of the training texts. The word so far
gives a known word its exact share. The predictions are mixed in the logistic domain by weights that a gate chooses (bit
place, longest context seen before, how often the word so far was), trained online; a table of observed rates refines the mixed
prediction (by gate and prediction).

No context of a bit beyond the first HEAD bytes of a word reaches the word before, so a token falls into pieces: a link for
each of its first bytes, told by the ORDERS bytes up to it (the blank left out), and its tail, told by the word. Bits are
counted and predicted once for each piece, with the number of its tokens as weight, which gives the sums over all tokens.

Along a text the predictions are refined: the words of the text so far, and the shares of the word in each class of training
documents (their language, say), are mixed in by experts, whose weights adapt to how well each did so far. Classes of
the scored texts are not looked at.

All counts cover the whole corpus. Pieces are counted per chunk of documents, so that only distinct ones of a chunk are
shuffled, and the predictions come back to the chunk the same way; texts and word tables never pass the driver. Contexts are
named by 64-bit hashes; which bytes followed each is a table of its own, joined to the contexts of the pieces to be
predicted, block by block. The words so far need no join: words are sorted, so a block holds all words that begin like one of
its own, but for the beginnings of its first and last. Weights and rates are tables of fixed size.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import partial
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.catalog.base import table
from foliant.llm.base import LOWER, UPPER, give_back, in_batches, lean, picked, query
from foliant.llm.repeats import forget, settle

if TYPE_CHECKING:
    import pyarrow as pa

CHUNK_TOKENS = 1 << 22  # tokens after which a chunk of documents ends
ORDERS = 4
HEAD = ORDERS - 1  # bytes of a word whose contexts reach the word before
INPUTS = ORDERS + 1  # the word so far, and the orders
SLOT_BITS = 20  # words are spelled in batches of at most so many bits (as a power of two), or one word
BLOCK = 16  # batches that share their contexts
BLOCK_BYTES = 1 << 21
SUM_TASKS = 16  # tasks that add up what the blocks learnt
SCORED_TOKENS = 1 << 18  # tokens scored at once, or one text
SLICE_BYTES = 1 << 22  # texts parted into words at once, or one text
PACKED_ROWS = 1 << 19  # pieces gathered before they are packed by chunk
DENSE = 1 << 24  # cells of the largest table that ranks links
CLASSES = 5  # the most frequent classes of training documents, all others together being the last
SEEN = (0.5, 3.5, 31.5)  # bounds of how often the gate takes the word so far to have been seen
GATES = 8 * (ORDERS + 1) * (len(SEEN) + 1)
STEPS = 33  # steps of the prediction in the table of rates
BATCH = 8192  # pieces whose bits are looked up at once
UPDATE = 1024  # pieces whose errors make one online update
RATE = 0.6
PRIOR = 0.05  # zeros and ones that each slot is taken to have seen before
EXPERTS = [(0.0, 0.0), (0.1, 0.05), (0.4, 0.1)]  # what the shares of a class and the text's own words count for
MODULUS, HELD_OUT = 7, 2
END = b""  # stands for the end of a text; no word is empty
BLANK = b" "  # no word holds one; the names of links begin with it

_FOLD = np.frombuffer(bytes.maketrans(UPPER.encode(), LOWER.encode()), np.uint8)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


# -- the bit model -----------------------------------------------------------------------------------------------------


class Bits(NamedTuple):
    """The coded bits of some words: slots by order, the bits, the gate's bit place, and the word of each."""

    slots: np.ndarray  # INPUTS x bits; numbers of the codes
    bit: np.ndarray
    place: np.ndarray
    word: np.ndarray
    keys: np.ndarray  # distinct contexts of bytes
    codes: np.ndarray  # distinct contexts of bits: 256 times the number of the key, and the bits of the byte so far after a 1


_BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _contexts(words: list[bytes], before: np.ndarray, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with a blank after each, sizes of the words, and a 64-bit hash of each byte's contexts.

    The first is the word so far, the others are the last bytes by order. ``before`` holds the bytes that end the word before,
    the last one lowest.
    """
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    spelled = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    n = len(spelled)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(n) - starts
    ends = np.repeat(np.asarray(before, np.int64), sizes)
    keys = np.empty((orders + 1, n), np.uint64)
    powers = np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    so_far = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[spelled] * np.multiply.accumulate(powers)[at], dtype=np.uint64)])
    context = so_far[:n] - so_far[starts] + np.uint64(0xD6E8FEB86659FD93)
    context = (context ^ (context >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    keys[0] = (context ^ (context >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    context = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(orders):
        back = np.empty(n, np.uint64)
        back[k + 1 :] = spelled[: max(n - k - 1, 0)]
        back[: k + 1] = 0
        outside = np.flatnonzero(at <= k)
        beyond = k - at[outside]  # 0 is the blank
        back[outside] = np.where(beyond == 0, BLANK[0], (ends[outside] >> (8 * np.maximum(beyond - 1, 0))) & 255)
        context = (context ^ (back + np.uint64(512 * (k + 1)))) * np.uint64(0xBF58476D1CE4E5B9)
        context ^= context >> np.uint64(29)
        keys[k + 1] = context * np.uint64(0x94D049BB133111EB)
    return spelled, sizes, keys.view(np.int64)


def _kept(sizes: np.ndarray, places: np.ndarray | None) -> np.ndarray:
    """Numbers of the bytes that belong to the pieces: those at their places, of tails (at HEAD) all beyond too."""
    if places is None:
        return np.arange(sizes.sum())
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.flatnonzero(np.minimum(at, HEAD) == np.repeat(places, sizes))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and which one each is; few distinct ones are found faster so than by sorting all."""
    import pyarrow as pa

    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[coded.indices.to_numpy()]


def bits_of(words: list[bytes], before: np.ndarray, places: np.ndarray | None = None) -> Bits:
    """Each word is spelled with a blank after it, 8 bits a byte, high bits first, after the bytes ``before``.

    With ``places`` only the bits of the pieces are told: see ``_kept``.
    """
    spelled, sizes, contexts = _contexts(words, before)
    kept = _kept(sizes, places)
    return _bits(spelled[kept], contexts[:, kept], np.repeat(np.arange(len(words)), sizes)[kept])


def _bits(spelled: np.ndarray, contexts: np.ndarray, word: np.ndarray) -> Bits:
    """The bits of bytes in their contexts."""
    n = len(spelled)
    depth = np.arange(8)
    keys, number = _distinct(contexts.reshape(-1))
    pairs, followed = _distinct(number * 256 + np.tile(spelled, INPUTS))
    # Pairs are in order, and so are their beginnings at each depth.
    slot, codes = np.empty((len(pairs), 8), np.int32), []
    for d in range(8):
        node = (pairs & ~255) | (1 << d) | ((pairs & 255) >> (8 - d))
        first = np.concatenate([[True], node[1:] != node[:-1]])[: len(pairs)]
        slot[:, d] = np.cumsum(first) - 1 + sum(map(len, codes))
        codes.append(node[first])
    bit = (spelled[:, None] >> (7 - depth)) & 1
    place = np.broadcast_to(depth, (n, 8))
    return Bits(slot[followed].reshape(INPUTS, -1), bit.reshape(-1).astype(np.float32), place.reshape(-1), np.repeat(word, 8), keys, np.concatenate(codes))


class Slots(NamedTuple):
    """Zeros and ones that each slot has seen."""

    zeros: np.ndarray
    ones: np.ndarray

    @staticmethod
    def of(bits: Bits, key: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Slots:
        """Counts of the codes of ``bits``, out of how often each byte followed each context; ordered by key and byte."""
        if not len(key):
            return Slots(np.zeros(len(bits.codes)), np.zeros(len(bits.codes)))
        number = np.searchsorted(bits.keys, key).clip(max=len(bits.keys) - 1)
        met = bits.keys[number] == key
        return Slots.at(bits, number[met] * 256 + byte[met], n[met])

    @staticmethod
    def at(bits: Bits, followed: np.ndarray, n: np.ndarray) -> Slots:
        """The same, with the numbers of the contexts in ``bits`` (times 256) and the bytes, in order."""
        counts = np.concatenate([[0], np.cumsum(n)])
        depth = np.frexp((bits.codes & 255).astype(np.float64))[1] - 1
        cuts = np.searchsorted(depth, np.arange(9))
        zeros, ones = np.empty(len(bits.codes)), np.empty(len(bits.codes))
        for d in range(8):
            codes = bits.codes[cuts[d] : cuts[d + 1]]
            first, node = codes & ~255, codes & 255
            width = 256 >> d  # bytes that begin with the bits so far
            low = first + node * width - 256
            if d:  # what one knows of the bits so far begins and ends where a half of those before it does
                parent = first | (node >> 1)
                of = np.cumsum(np.diff(parent, prepend=parent[:1]) != 0)
                right = (node & 1) > 0
                before, after = np.where(right, middle[of], before[of]), np.where(right, after[of], middle[of])
            else:
                before, after = (counts[np.searchsorted(followed, x)] for x in (low, low + width))
            middle = counts[np.searchsorted(followed, low + width // 2)]
            zeros[cuts[d] : cuts[d + 1]], ones[cuts[d] : cuts[d + 1]] = middle - before, after - middle
        return Slots(zeros, ones)

    def inputs(self, bits: Bits, without_own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of the contexts in the logistic domain, and the gate.

        A word of the training texts is predicted as if it had not been counted (``without_own``).
        """
        told, seen, at = [], [], bits.slots
        for own in (0, 1) if without_own else (None,):
            zeros = np.maximum(self.zeros - (own == 0), 0)
            ones = np.maximum(self.ones - (own == 1), 0)
            told.append(np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float32))
            seen.append(np.digitize(zeros + ones, SEEN).astype(np.int8))
        if without_own:
            at = at + bits.bit.astype(np.int32) * np.int32(len(self.zeros))
        met = np.concatenate(seen)[at]
        longest = (met[1:] > 0).sum(axis=0, dtype=np.int8)  # a longer context was seen only if the shorter ones were
        return np.concatenate(told)[at], (bits.place * (ORDERS + 1) + longest) * (len(SEEN) + 1) + met[0]


class Mixer(NamedTuple):
    """Weights by gate and order, and observed zeros and ones by gate and step of the prediction."""

    weights: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @staticmethod
    def fresh() -> Mixer:
        start = np.full((GATES, INPUTS), 0.3, np.float32)
        return Mixer(start, np.zeros(GATES * STEPS), np.zeros(GATES * STEPS))

    def mixed(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(gate), np.float32)
        for k, x in enumerate(inputs):
            mixed += self.weights[:, k][gate] * x
        return mixed.clip(-10, 10)

    @staticmethod
    def step_of(mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * STEPS + np.rint((mixed + 10) * ((STEPS - 1) / 20)).astype(np.int64)

    def learn(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None = None) -> Mixer:
        """One online step on a batch of bits, each told ``weight`` times."""
        weight = np.ones(len(bit), np.float32) if weight is None else weight
        mixed = self.mixed(inputs, gate)
        error = weight * (bit - 1 / (1 + np.exp(-mixed)))
        count = np.bincount(gate, weights=weight, minlength=GATES) + 1.0
        slope = np.stack([np.bincount(gate, weights=error * x, minlength=GATES) / count for x in inputs], axis=1)
        at = self.step_of(mixed, gate)
        ones = np.bincount(at, weights=bit * weight, minlength=GATES * STEPS)
        return Mixer(
            (self.weights + RATE * slope).astype(np.float32),
            self.zeros + np.bincount(at, weights=weight, minlength=GATES * STEPS) - ones,
            self.ones + ones,
        )

    def log2_of(self, inputs: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log2 of the probability of each bit: the mixed prediction and its observed rate, averaged in the logistic domain."""
        mixed = self.mixed(inputs, gate)
        step = self.step_of(mixed, gate)
        centre = np.tile(np.arange(STEPS) * (20 / (STEPS - 1)) - 10, GATES)
        # A rate that was hardly observed stays near the prediction it belongs to.
        prior = 4 / (1 + np.exp(-centre))
        rate = np.log((self.ones + prior) / (self.zeros + 4 - prior))
        final = (mixed + rate[step]) / 2
        return -np.logaddexp(0, np.where(bit > 0, -final, final)) / np.log(2)


class _Pieces(NamedTuple):
    """Links and tails of words: the bytes, those before, the place, the number of tokens in training texts, and the facts."""

    names: list[bytes]
    words: list[bytes]
    before: np.ndarray
    places: np.ndarray
    n: np.ndarray
    facts: list[bytes]

    @staticmethod
    def of(names: list[bytes], facts: list[bytes]) -> _Pieces:
        words, before, places = names.copy(), np.zeros(len(names), np.int64), np.full(len(names), HEAD)
        for i, w in enumerate(names):
            if w.startswith(BLANK):
                place = w[1]
                places[i], before[i], words[i] = place, int.from_bytes(w[2 : 2 + HEAD - place], "big"), w[2 + HEAD - place :].rstrip(BLANK)
        n = np.frombuffer(b"".join(facts), "<f8").reshape(-1, CLASSES).sum(axis=1)
        return _Pieces(names, words, before, places, n, facts)

    def part(self, i: int, j: int) -> _Pieces:
        return _Pieces(*(column[i:j] for column in self))

    def bits(self) -> tuple[Bits, np.ndarray, np.ndarray]:
        """The bits of the distinct bytes in their contexts, which of these each byte of the pieces is, and its piece."""
        import pyarrow as pa

        spelled, sizes, contexts = _contexts(self.words, self.before)
        kept = _kept(sizes, self.places)
        spelled, contexts = spelled[kept], contexts[:, kept]
        # The word so far and the longest context tell the others.
        alike = (contexts[0].view(np.uint64) ^ (contexts[-1].view(np.uint64) * _BYTES[0])) + _BYTES[spelled]
        which = pa.array(alike).dictionary_encode().indices.to_numpy()
        one = np.zeros(which.max(initial=-1) + 1, np.int64)
        one[which] = np.arange(len(which))
        return _bits(spelled[one], contexts[:, one], one), which, np.repeat(np.arange(len(self.names)), sizes)[kept]

    def followed(self, so_far: bool, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, bytes that followed them and how often: all but the words so far of tails, or (``so_far``) these (``among`` some)."""
        spelled, sizes, contexts = _contexts(self.words, self.before, 0 if so_far else ORDERS)
        kept = _kept(sizes, self.places)
        spelled, contexts, n = spelled[kept], contexts[:, kept], np.repeat(self.n, sizes)[kept]
        link = np.repeat(self.places < HEAD, sizes)[kept]
        if so_far:
            key, byte, n = contexts[0, ~link], spelled[~link], n[~link]
        else:
            key = np.concatenate([contexts[1:].reshape(-1), contexts[0, link]])
            byte, n = (np.concatenate([np.tile(x, ORDERS), x[link]]) for x in (spelled, n))
        if among is not None:
            some = np.isin(key, among)
            key, byte, n = key[some], byte[some], n[some]
        keys, number = _distinct(key)
        pairs, at = _distinct(number * 256 + byte)
        return keys[pairs >> 8], pairs & 255, np.bincount(at, weights=n, minlength=len(pairs)).astype(np.int64)

    def shared(self) -> np.ndarray:
        """The words so far of the first and the last tail, which other blocks may hold too."""
        tails = [w for w, p in zip(self.words, self.places, strict=True) if p == HEAD]
        edges = [min(tails), max(tails)] if tails else []
        return _contexts(edges, np.zeros(len(edges), np.int64), 0)[2][0]


def _batches(names: list[bytes], facts: list[bytes]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Batches of bounded numbers of pieces and bits."""
    begin, size = 0, 0
    for i, w in enumerate(names):
        size += len(w) + 1
        if i > begin and (i - begin == BATCH or size * 8 > 1 << SLOT_BITS):
            yield names[begin:i], facts[begin:i]
            begin, size = i, len(w) + 1
    if begin < len(names):
        yield names[begin:], facts[begin:]


def _named(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    """(word, counts by class) as names and facts."""
    counts = np.stack([batch.column(f"c{k}").to_numpy() for k in range(CLASSES)], axis=1).astype("<f8").tobytes()
    return batch.column("word").to_pylist(), [counts[i : i + 8 * CLASSES] for i in range(0, len(counts), 8 * CLASSES)]


def _blocking(batches: Iterator[pa.RecordBatch], asked: bool = False) -> Iterator[pa.RecordBatch]:
    """Sorted (word, counts by class) to blocks of pieces, a row for each batch, and the contexts each asks for.

    A context that other blocks may share has rows that say which bytes followed it in this one (``byte``, ``n``): words so
    far of tails at the block's edges and (``asked``) all that it asks for.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    block, names, facts, size = TaskContext.get().partitionId() << 32, [], [], 0
    many = pa.list_(pa.binary())
    schema = pa.schema([("block", pa.int64()), ("words", many), ("facts", many), ("key", pa.int64()), ("byte", pa.int16()), ("n", pa.int64())])

    def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), *(columns.get(f.name, pa.nulls(rows, f.type)) for f in list(schema)[1:])], schema=schema)

    def done() -> Iterator[pa.RecordBatch]:
        pieces = _Pieces.of(names, facts)
        steps = -(-len(names) // UPDATE)  # so that each update sees words of the whole block
        mixed = [[x for i in range(steps) for x in column[i::steps]] for column in (names, facts)]
        for part in _batches(*mixed):
            yield batch_of(1, **{c: pa.array([x], many) for c, x in zip(("words", "facts"), part, strict=True)})
        shared = pieces.shared()
        told = [pieces.followed(so_far=False), pieces.followed(so_far=True, among=shared)]
        keys = np.union1d(told[0][0], shared)
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield batch_of(len(part), key=pa.array(part))
        for key, byte, n in told if asked else told[1:]:
            for i in range(0, len(key), 100_000):
                part = slice(i, i + 100_000)
                yield batch_of(len(key[part]), key=pa.array(key[part]), byte=pa.array(byte[part].astype(np.int16)), n=pa.array(n[part]))

    for batch in batches:
        for name, fact in zip(*_named(batch), strict=True):
            names.append(name)
            facts.append(fact)
            size += len(name) + 1
            if len(names) == BLOCK * BATCH or size > BLOCK_BYTES:
                yield from done()
                block, names, facts, size = block + 1, [], [], 0
    if names:
        yield from done()


class _Block(NamedTuple):
    """Batches of pieces, and which bytes followed their contexts in the training words."""

    batches: list[_Pieces]
    keys: np.ndarray  # distinct contexts in order
    begin: np.ndarray  # where each one's rows begin (and the last one's end)
    byte: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(words: pa.Table, followed: pa.Table) -> _Block:
        told = sorted(zip(words.column("words").to_pylist(), words.column("facts").to_pylist(), strict=True))
        whole = _Pieces.of(*([x for part in column for x in part] for column in zip(*told, strict=True)))
        own = whole.followed(so_far=True)
        unshared = ~np.isin(own[0], whole.shared())
        lists = followed.column("told").combine_chunks()
        values = lists.flatten().to_numpy()
        met = np.repeat(followed.column("key").to_numpy(), lists.value_lengths().to_numpy()), values & 255, values >> 8
        key, byte, n = (np.concatenate([x, y[unshared]]) for x, y in zip(met, own, strict=True))
        keys, number = _distinct(key)
        order = np.argsort(number * 256 + byte)
        begin = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(keys)))])
        ends = np.cumsum([0, *(len(w) for w, _ in told)])
        return _Block([whole.part(i, j) for i, j in itertools.pairwise(ends)], keys, begin, byte[order], n[order])

    def slots(self, bits: Bits) -> Slots:
        at = np.searchsorted(self.keys, bits.keys)
        met = np.flatnonzero(np.append(self.keys, 0)[at] == bits.keys)
        met = met[at[met] < len(self.keys)]
        begin, end = self.begin[at[met]], self.begin[at[met] + 1]
        sizes = end - begin
        rows = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        return Slots.at(bits, np.repeat(met, sizes) * 256 + self.byte[rows], self.n[rows])


def _training(words: pa.Table, followed: pa.Table) -> pa.Table:
    """One online pass over a block's pieces; results are a row of sums, to be averaged over blocks by their tokens."""
    import pyarrow as pa

    mixer, n, block = Mixer.fresh(), 0.0, _Block.of(words, followed)
    for pieces in block.batches:
        bits, which, word = pieces.bits()
        inputs, gate = block.slots(bits).inputs(bits, without_own=True)
        inputs, gate, bit = inputs.reshape(INPUTS, -1, 8), gate.reshape(-1, 8), bits.bit.reshape(-1, 8)
        cuts = [*np.searchsorted(word, np.arange(0, len(pieces.n), UPDATE)), len(word)]
        for i, j in itertools.pairwise(cuts):
            of, weight = which[i:j], np.repeat(pieces.n[word[i:j]].astype(np.float32), 8)
            mixer = mixer.learn(inputs[:, of].reshape(INPUTS, -1), gate[of].reshape(-1), bit[of].reshape(-1), weight)
        n += pieces.n.sum()
    values = np.concatenate([[n], n * mixer.weights.reshape(-1).astype(np.float64), mixer.zeros, mixer.ones])
    return pa.table({"sums": pa.array([values.astype("<f8").tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums to their own sum, one row a task."""
    import pyarrow as pa

    total = None
    for batch in batches:
        for row in batch.column("sums"):
            values = np.frombuffer(row.as_py(), "<f8")
            total = values if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _spelling(mixer) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Pieces of a block to (word, facts): the counts by class, and the natural logarithm of the piece's probability.

    They travel in single precision: counts above 2 ** 24 are rounded to 24 bits.
    """

    def spell(words: pa.Table, followed: pa.Table) -> pa.Table:
        import pyarrow as pa

        block, told, packed = _Block.of(words, followed), [], []
        for pieces in block.batches:
            bits, which, word = pieces.bits()
            inputs, gate = block.slots(bits).inputs(bits, without_own=False)
            log2 = mixer.value.log2_of(inputs, gate, bits.bit).reshape(-1, 8).sum(axis=1)
            spelled = np.bincount(word, weights=log2[which], minlength=len(pieces.names)) * np.log(2)
            counts = np.frombuffer(b"".join(pieces.facts), "<f8").reshape(-1, CLASSES)
            told += pieces.names
            packed += [row.tobytes() for row in np.column_stack([counts, spelled]).astype("<f4")]
        give_back()
        return pa.table({"word": pa.array(told, pa.binary()), "facts": pa.array(packed, pa.binary())})

    return spell


def _in_blocks(blocks: DataFrame, followed: DataFrame):
    """Blocks of pieces, together with the bytes that followed their contexts."""
    met = blocks.where("key IS NOT NULL AND byte IS NULL").select("block", "key").join(followed, "key").select(F.col("block").alias("of"), "key", "told")
    return blocks.where("key IS NULL").select("block", "words", "facts").groupBy("block").cogroup(met.groupBy("of"))


# -- documents as numbers of their chunk's words -----------------------------------------------------------------------


def _bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and where each begins (and the last ends); null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts and an END after those of each text, and how many tokens each text has."""
    import pyarrow as pa

    folded = _FOLD[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    for edge, at in ((first, offsets[:-1][some]), (last, offsets[1:][some] - 1)):
        edge[at] = inside[at]
    begin = np.flatnonzero(first)
    upto = np.searchsorted(begin, offsets)
    sizes = np.insert(np.flatnonzero(last) - begin + 1, upto[1:], len(END))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(folded[inside])])
    return words, np.diff(upto) + 1


def _ends(words: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The last HEAD bytes of each word, then its first ones, as one number; what a word lacks is blank."""
    data, offsets = _bytes_of(words)
    data = np.append(data, BLANK[0])
    begin, end = offsets[:-1], offsets[1:]
    number = np.zeros(len(begin), np.int64)
    for at in [*(end - back for back in range(HEAD, 0, -1)), *(begin + i for i in range(HEAD))]:
        number = (number << 8) | data[np.where((at >= begin) & (at < end), at, len(data) - 1)]
    return number


def _ranked_in(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of values below ``size`` in order, and which one each is, by a table of that size."""
    there = np.zeros(size, bool)
    there[values] = True
    found = np.flatnonzero(there)
    rank = np.zeros(size, np.int32)
    rank[found] = np.arange(len(found), dtype=np.int32)
    return found, rank[values]


def _links(cat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct links of texts as numbers in order (place, then ORDERS bytes), and which one each token has at each place.

    ``cat`` are the words' numbers, text after text; each ends with END, whose ends are blank, as is what stands before a text.
    """
    first, last = ends & ((1 << 8 * HEAD) - 1), ends >> 8 * HEAD
    before = np.roll(cat, 1)
    keys, which = [], np.empty((HEAD, len(cat)), np.int32)
    for place in range(HEAD):
        heads, head = _distinct(first >> 8 * (HEAD - 1 - place))
        tails, tail = _distinct(last & ((1 << 8 * (HEAD - place)) - 1))
        cells = len(heads) * len(tails)
        if cells <= DENSE:
            pair, which[place] = _ranked_in((tail * len(heads)).astype(np.int32)[before] + head.astype(np.int32)[cat], cells)
        else:
            pair, which[place] = _distinct((tail * len(heads))[before] + head[cat])
        which[place] += sum(map(len, keys))
        high, low = np.divmod(pair, len(heads))
        keys.append((place << 8 * ORDERS) | (tails[high] << 8 * (place + 1)) | heads[low])
    return np.concatenate(keys), which


def _coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, class, text) to rows of documents (ids) and of distinct words and links (number, counts) of each chunk.

    Words are numbered as they come, links after them in order. Counts of links are not by class: all are the first's.
    """
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    pack = zstandard.ZstdCompressor(level=1).compress
    rows: list[pa.RecordBatch] = []  # of the chunk: documents, their words and numbers of tokens
    words: list[pa.Array] = []  # distinct ones of each slice
    ids: list[np.ndarray] = []  # numbers of the tokens in these
    sizes: list[np.ndarray] = []
    tokens = 0
    schema = None

    def coded(chunk: int, rows: list[pa.RecordBatch], words: list[pa.Array], ids: list[np.ndarray], sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        encoded = pa.concat_arrays(words).dictionary_encode()
        number, names = encoded.indices.to_numpy(), encoded.dictionary
        slices = np.split(number, np.cumsum([len(x) for x in words])[:-1])
        cat = np.concatenate([x[i] for x, i in zip(slices, ids, strict=True)])
        words.clear()
        ids.clear()
        begin = np.cumsum(sizes) - sizes
        none = (None,) * (CLASSES + 2)
        doc, held, n_bytes, cls = ([x for b in rows for x in b.column(c).to_pylist()] for c in ("doc_id", "held_out", "n_bytes", "class"))
        planes_of = (cat[i : i + n].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for i, n in zip(begin, sizes, strict=True))  # high bytes together, which are mostly 0
        yield from in_batches(((chunk, *told, pack(planes), *none) for *told, planes in zip(doc, held, n_bytes, planes_of, strict=True)), schema)

        links, which = _links(cat, _ends(names))
        of = np.repeat([CLASSES if h else k for h, k in zip(held, cls, strict=True)], sizes)
        n = len(names)
        counts = np.zeros((n + len(links), CLASSES), np.int64)
        counts[:n] = np.bincount(cat * np.int64(CLASSES + 1) + of, minlength=n * (CLASSES + 1)).reshape(n, -1)[:, :CLASSES]
        learnt = of < CLASSES
        counts[n:, 0] = sum(np.bincount(x[learnt], minlength=len(links)) for x in which)
        named = links.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 7 - ORDERS :]
        names = pa.concat_arrays([names, pa.array([BLANK + row.tobytes() for row in named], names.type)])
        size = 100_000
        for i in range(0, len(names), size):
            n = min(size, len(names) - i)
            part = names.take(pa.array(np.arange(i, i + n))).cast(pa.binary())
            empty = [pa.nulls(n, f.type) for f in list(schema)[1:5]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk)), *empty, part, pa.array(np.arange(i, i + n, dtype=np.int32)),
                 *(pa.array(counts[i : i + n, k]) for k in range(CLASSES))], schema=schema
            )

    for batch in batches:
        schema = schema or pa.schema(
            [("chunk", pa.int64()), ("doc_id", batch.column("doc_id").type), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("ids", pa.binary()),
             ("word", pa.binary()), ("number", pa.int32()), *((f"c{k}", pa.int64()) for k in range(CLASSES))]
        )
        data, offsets = _bytes_of(batch.column("text"))
        told = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "class")), pa.array(np.diff(offsets))], ["doc_id", "held_out", "class", "n_bytes"])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
            found, n = _words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            upto = np.cumsum(n)
            while len(n):
                k = min(int(np.searchsorted(upto, CHUNK_TOKENS - tokens)) + 1, len(n))  # documents until the chunk is full
                rows.append(told.slice(i, k))
                encoded = found.slice(0, upto[k - 1]).dictionary_encode()
                words.append(encoded.dictionary)
                ids.append(encoded.indices.to_numpy())
                sizes.append(n[:k])
                tokens += int(upto[k - 1])
                i, n, found, upto = i + k, n[k:], found.slice(upto[k - 1]), upto[k:] - upto[k - 1]
                if tokens >= CHUNK_TOKENS:
                    yield from coded(chunk, rows, words, ids, np.concatenate(sizes))
                    rows, words, ids, sizes, tokens, chunk = [], [], [], [], 0, chunk + 1
    if rows:
        yield from coded(chunk, rows, words, ids, np.concatenate(sizes))


# -- what the model says, back to the chunks ---------------------------------------------------------------------------


_PIECE = [("<i4", 1), ("<i8", 1), ("<f4", CLASSES + 1)]  # a piece's number, ends and facts


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, number, word, facts) to rows of many pieces of a chunk, packed (of, pieces)."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        number, word = rows.column("number").to_numpy(), rows.column("word")
        facts = _bytes_of(rows.column("facts"))[0].view("<f4").reshape(-1, CLASSES + 1)
        chunk = rows.column("of").to_numpy()
        order = np.lexsort((number, chunk))
        columns = [x[order].astype(kind).reshape(-1, width) for x, (kind, width) in zip((number, _ends(word), facts), _PIECE, strict=True)]
        chunk = chunk[order]
        cuts = [*np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1)), len(chunk)]
        planes = (b"".join(x[i:j].view(np.uint8).reshape(j - i, -1).T.tobytes() for x in columns) for i, j in itertools.pairwise(cuts))
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array([pack(x) for x in planes], pa.binary())], ["of", "pieces"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= PACKED_ROWS:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ends and facts (by column) of a chunk's pieces, in the order of their numbers."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    widths = [np.dtype(kind).itemsize * width for kind, width in _PIECE]
    parts = [[], [], []]
    for planes in packed:
        planes = np.frombuffer(unpack(planes), np.uint8).reshape(sum(widths), -1)
        for part, x, (kind, width) in zip(parts, np.split(planes, np.cumsum(widths)[:-1]), _PIECE, strict=True):
            part.append(np.ascontiguousarray(x.T).view(kind).reshape(-1, width))
    number, ends, facts = (np.concatenate(x) for x in parts)
    by_number = np.empty(len(number), np.int64)
    by_number[number[:, 0]] = np.arange(len(number))
    return ends[by_number, 0], facts.T[:, by_number].astype(np.float64)


def _before(cat: np.ndarray, text: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each token's word stands before it in its text."""
    bits = [int(x.max(initial=0)).bit_length() for x in (text, cat, at)]
    if sum(bits) < 63:
        whole = np.sort((((text.astype(np.int64) << bits[1]) | cat) << bits[2]) | at)
        place = whole & ((1 << bits[2]) - 1)
        whole >>= bits[2]
        order = begin[whole >> bits[1]] + place
        first = np.diff(whole, prepend=-1) != 0
    else:
        order = np.lexsort((cat, text))
        first = np.concatenate([[True], (np.diff(cat[order]) != 0) | (np.diff(text[order]) != 0)])
    run = np.arange(len(cat))
    run -= np.maximum.accumulate(np.where(first, run, 0))
    found = np.empty(len(cat))
    found[order] = run
    return found


class _Model(NamedTuple):
    """What the counts say as a whole: tokens and documents by class, all tokens, distinct words."""

    by_class: np.ndarray
    total: int
    distinct: int

    def scores(self, ids: list[np.ndarray], spelled: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of texts, out of the natural logarithms of their tokens and the words' counts by class.

        An expert (a class, and a row of EXPERTS) takes the share of the word in its class and among the text's words so
        far into the token's probability. The weight of an expert is its prior share times the probability it gave to the
        text so far. Mixed by such weights, the probabilities of the words multiply to the prior-weighted mean of the
        experts' products, which is what is computed.
        """
        sizes = np.array([len(x) for x in ids])
        begin, cat = np.cumsum(sizes) - sizes, np.concatenate(ids)
        text = np.repeat(np.arange(len(ids)), sizes)
        at = np.arange(len(cat)) - np.repeat(begin, sizes)
        again = _before(cat, text, at, begin) / np.maximum(at, 1)
        prior = (self.by_class + 1) / (self.by_class + 1).sum() / len(EXPERTS)
        # The sum of two probabilities is taken as it is, but where the one that was spelled is too small for a double.
        chance = np.exp(spelled)
        small = np.flatnonzero(chance < 1e-290)
        shares = {k: (counts[:, k] / self.by_class[k])[cat] for k in range(CLASSES) if self.by_class[k]}
        said = []
        for of_class, of_text in EXPERTS:
            if not of_class and not of_text:
                said.append(np.add.reduceat(spelled, begin) + np.log(1 / len(EXPERTS)))
                continue
            part = np.where(at > 0, of_text, 0)
            rest = np.maximum(1 - of_class - part, 1e-300)
            repeated = part * again
            known = rest * chance + repeated
            for k in shares if of_class else [None]:
                share = of_class * shares[k] if of_class else np.zeros(len(cat))
                with np.errstate(divide="ignore"):
                    mixed = np.log(known + share)
                    mixed[small] = np.logaddexp(np.log(rest[small]) + spelled[small], np.log(share[small] + repeated[small]))
                said.append(np.add.reduceat(mixed, begin) + np.log(prior[k] if k is not None else 1 / len(EXPERTS)))
        told = np.stack(said)
        top = told.max(axis=0)
        return (top + np.log(np.exp(told - top).sum(axis=0))) / np.log(10)


def _scoring(model: _Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, pieces: pa.Table) -> pa.Table:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        ids = [np.frombuffer(unpack(x.as_py()), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1) for x in docs.column("ids")]
        score_, sums = np.empty(0), np.empty((2, 0))
        if ids:
            ends, facts = _unpacked(pieces.column("pieces").to_pylist())
            c = facts[:CLASSES].sum(axis=0)
            base = np.log10((c + 1) / (model.total + (model.distinct + 1)))
            sizes = np.array([len(x) for x in ids])
            cat = np.concatenate(ids)
            upto = np.cumsum(sizes)
            ids = np.split(cat, upto[:-1])
            begin, n = upto - sizes, cat.max() + 1
            links = _links(cat, ends[:n])[1]  # as they were numbered
            counts, spelled, of_links = facts[:CLASSES, :n].T, facts[CLASSES, :n], facts[CLASSES, n:]
            told, summed, i = [], [], 0
            while i < len(ids):  # some texts at once, or one
                j = max(i + 1, int(np.searchsorted(upto, begin[i] + SCORED_TOKENS, "right")))
                some = slice(begin[i], upto[j - 1])
                told.append(model.scores(ids[i:j], spelled[cat[some]] + sum(of_links[x[some]] for x in links), counts))
                summed.append(np.stack([np.add.reduceat(x[cat[some]], begin[i:j] - begin[i]) for x in ((c > 0).astype(np.float64), base)]))
                i = j
            score_, sums = np.concatenate(told), np.concatenate(summed, axis=1)
        size = docs.column("n_bytes").to_numpy()
        give_back()
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "n_known": pa.array(sums[0].astype(np.int64)),
                "train_tokens": pa.array([model.total] * len(ids), pa.int64()),
                "base_score": pa.array(sums[1]),
                "score": pa.array(score_, pa.float64()),
                "bits_per_byte": pa.array(np.where(size > 0, -score_ * np.log2(10) / np.maximum(size, 1), np.nan), pa.float64(), from_pandas=True),
            }
        )

    return score


def mixing_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the words of the text after lower-casing A-Z, parted by ASCII white space, and one end. Documents whose
    crc32 of the id as text leaves HELD_OUT modulo MODULUS are held out: nothing is learnt from them. A null id counts
    as empty text there (and so is learnt from). Null, empty and blank texts are an end alone; bits_per_byte of a text
    without bytes is null. base_score is the score of the add-one unigram model of the same counts. Repeated rows are
    documents of their own. ``class_col`` names the class of training documents; without it, or where it is null, they
    are of one class. The scored documents' own classes are not used.
    """
    spark = docs.sparkSession
    slim = picked(docs, doc_id=id_col, text=text_col, **({"class": class_col} if class_col else {}))
    if not class_col:
        slim = slim.withColumn("class", F.lit(None).cast("string"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % MODULUS == HELD_OUT
    named = slim.where(~held).groupBy("class").count().where("class IS NOT NULL").orderBy(F.desc("count"), "class")
    names = [r["class"] for r in named.limit(CLASSES - 1).collect()]
    number = F.lit(CLASSES - 1)
    for k, name in enumerate(names):
        number = F.when(F.col("class") == F.lit(name), k).otherwise(number)
    by_class = [f"c{k}" for k in range(CLASSES)]
    rows = f"chunk bigint, doc_id {kind}, held_out boolean, n_bytes bigint, ids binary, word binary, number int, {', '.join(f'{c} bigint' for c in by_class)}"
    coded = settle(slim.select("doc_id", held.alias("held_out"), number.alias("class"), "text").mapInArrow(lean(_coding), rows), "mixing-coded")
    local = coded.where("word IS NOT NULL")
    pieces = settle(local.groupBy("word").agg(*[F.sum(c).alias(c) for c in by_class]), "mixing-pieces")
    c = sum((F.col(x) for x in by_class[1:]), F.col(by_class[0]))
    is_link = F.coalesce(F.substring("word", 1, 1) == F.lit(BLANK), F.lit(False))
    stats = pieces.where(~is_link).agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in by_class],
        F.count(F.when(c > 0, 1)).alias("distinct"),
    ).first()
    total = sum(stats[x] for x in by_class)

    in_order = pieces.repartitionByRange("word").sortWithinPartitions("word")
    blocks = settle(in_order.mapInArrow(lean(partial(_blocking, asked=True)), "block bigint, words array<binary>, facts array<binary>, key bigint, byte smallint, n bigint"), "mixing-blocks")
    followed = blocks.where("byte IS NOT NULL AND n > 0").groupBy("key", "byte").agg(F.sum("n").alias("n"))
    # A row for each context, of at most 256 bytes: a block that asks for a context gets one row.
    followed = settle(followed.groupBy("key").agg(F.collect_list(F.col("n") * 256 + F.col("byte")).alias("told")), "mixing-contexts")
    # Weights and rates are tables of fixed size: GATES weight sets and rate rows.
    sums = _in_blocks(blocks, followed).applyInArrow(_training, "sums binary").repartition(SUM_TASKS).mapInArrow(_summed, "sums binary").toArrow()
    mixer = Mixer.fresh()
    values = sum(np.frombuffer(row, "<f8") for row in sums.column("sums").to_pylist())
    if sums.num_rows and values[0]:
        n_weights = GATES * INPUTS
        weights = (values[1 : 1 + n_weights] / values[0]).reshape(GATES, INPUTS).astype(np.float32)
        mixer = Mixer(weights, *np.split(values[1 + n_weights :], 2))
    mixers = spark.sparkContext.broadcast(mixer)

    facts = settle(_in_blocks(blocks, followed).applyInArrow(_spelling(mixers), "word binary, facts binary"), "mixing-facts")
    forget(spark, blocks, followed, pieces)
    back = local.select("chunk", "word", "number").join(facts, "word").select(F.col("chunk").alias("of"), "number", "word", "facts")
    back = back.mapInArrow(lean(_packing), "of bigint, pieces binary")
    texts = coded.where("word IS NULL").select("chunk", "doc_id", "held_out", "n_bytes", "ids")
    model = _Model(np.array([stats[x] for x in by_class], np.float64), int(total), int(stats["distinct"]))
    out = (
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    )
    scored = (
        texts.groupBy("chunk")
        .cogroup(back.groupBy("of"))
        .applyInArrow(_scoring(model), out)
    )
    done = settle(scored, "mixing-scores")
    forget(spark, coded, facts)
    return done


@query("op8_context_mixing")
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_scores(table(spark, sf_dir, "documents"), class_col="lang")
