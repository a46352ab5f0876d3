"""HyperMinHash sketches of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np

from foliant.llm.base import LOWER, UPPER
from foliant.llm.recompression import hashed_words, mixed
from foliant.llm.repeats import chunks

if TYPE_CHECKING:
    import pyarrow as pa

ROWS = 7  # registers in a band
BANDS = 48
REGISTERS = ROWS * BANDS
MANTISSA = 3  # bits kept after the leading one
MOST_ZEROS = 30
PROBES = 24  # probes for a value for an empty register that are made for many texts together

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ONE, _TWO, _THREE, _SHORT, _VALUE = (np.random.default_rng(20_013).integers(0, 1 << 63, 5, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a text in their order; of a shorter text, one of all its words."""
    hashes = hashed_words(text.translate(_FOLD))
    if len(hashes) == 0:
        return hashes
    if len(hashes) < words:
        name = _SHORT
        for h in hashes:
            name = mixed(np.array([name]) * _ONE + h)[0]
        return np.array([name], np.uint64)
    name = mixed(hashes[: len(hashes) - words + 1] ^ _TWO)
    for i in range(1, words):
        name = mixed(name * _ONE + hashes[i : len(hashes) - words + 1 + i])
    return name


def sets_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and the text's number for each."""
    parts = [shingle_hashes(t, words) for t in texts]
    for part in parts:
        part.sort()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _probe_orders() -> tuple[np.ndarray, np.ndarray]:
    """For each register the order in which it looks at the others for a value, and each one's rank in it."""
    order = np.argsort(np.random.default_rng(20_014).random((REGISTERS, REGISTERS)), axis=1)
    return order.T.copy(), np.argsort(order, axis=1)


_PROBE, _RANK = _probe_orders()


def registers_of(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """HyperMinHash registers (n x REGISTERS, one byte each) of sorted sets; only empty sets have empty registers, 0.

    The high bits of a hash choose the register. It keeps the least value in compressed form: how many zeros lead it,
    and the MANTISSA bits after its first one. A register without a value takes that of the first register in its own
    order that has one, so that registers agree with the sets' Jaccard similarity as probability for small sets too.
    """
    out = np.zeros((n, REGISTERS), np.uint8)
    if not len(hashes):
        return out
    register = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    place = owner * REGISTERS + register  # rises along the sorted sets
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    least = np.minimum.reduceat(mixed(hashes ^ _VALUE), first)
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], MOST_ZEROS).astype(np.uint64)
    after = least << zeros << np.uint64(1) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[place[first]] = (zeros + np.uint64(1) << np.uint64(MANTISSA) | after).astype(np.uint8)
    sparse = np.flatnonzero((out == 0).any(axis=1) & (out > 0).any(axis=1))
    own = out[sparse]
    filled = own.copy()
    for t in range(PROBES):
        filled = np.where(filled == 0, own[:, _PROBE[t]], filled)
    for row in np.flatnonzero((filled == 0).any(axis=1)):
        used = np.flatnonzero(own[row])
        nearest = own[row][used[_RANK[:, used].argmin(axis=1)]]
        filled[row] = np.where(own[row] == 0, nearest, own[row])
    out[sparse] = filled
    return out


def chance_collision() -> float:
    """Probability that the registers of two different values look alike.

    With probability 2 ** -(z + 1) each has z leading zeros; then the mantissas agree once in 2 ** MANTISSA.
    """
    return sum(4.0 ** -(z + 1) for z in range(MOST_ZEROS)) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate for registers in the last axis."""
    raw = ((a == b) & (a > 0)).mean(axis=-1)
    c = chance_collision()
    return (raw - c) / (1 - c)


def sketching(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tag, text) to (doc_id, tag, n_shingles, node, registers); node is a digest of the set, null if it is empty."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import xxhash

        for rows, texts, batch in chunks(batches):
            hashes, owner = sets_of(texts, words)
            sizes = np.bincount(owner, minlength=len(texts))
            ends = np.cumsum(sizes)
            view = memoryview(hashes).cast("B") if len(hashes) else memoryview(b"")
            nodes = [
                xxhash.xxh3_128_digest(view[8 * (end - size) : 8 * end]) if size else None
                for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)
            ]
            registers = registers_of(hashes, owner, len(texts))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("tag").take(take),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                ],
                ["doc_id", "tag", "n_shingles", "node", "registers"],
            )

    return sketch
