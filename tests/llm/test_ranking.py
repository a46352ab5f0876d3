"""Ranked search by shared parts, top-k by the threshold algorithm and hard negatives, against plain versions."""

import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from foliant.llm import shared_terms, vectors
from foliant.llm.negatives import MOVED, Inverted, hard_negatives
from foliant.llm.shared_terms import search_shared, share, terms_of
from foliant.llm.threshold import Lists, Top, search, top_products
from foliant.llm.vectors import Block, products

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(brute.folded(text))


def plain_search(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w in words(text)
                if w in c
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "İx", "日本", "a1"]
    odds = [1 / (i + 1) for i in range(len(vocabulary))]
    make = lambda n: " ".join(rng.choices(vocabulary, odds, k=n))
    docs = [(i, make(rng.randrange(1, 40))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " \n-_-"), (503, make(20_000)), (None, make(30)), (3, docs[3][1]), (7, docs[8][1])]
    docs += [(600 + i, "Twin, W1 w2") for i in range(30)]
    items = [(i, make(rng.randrange(2, 25))) for i in range(25)] + [(90, None), (91, "!!"), (92, "unheard"), (93, "twin twin w1")]
    return docs, items


def test_search_equals_plain_version(spark, texts):
    docs, items = texts
    left = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'x' AS score", "2 AS item", "3 AS rank")
    right = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "7 AS doc_id", "'y' AS df")
    got = search_shared(left, right, k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    brute.same([tuple(r) for r in got.collect()], plain_search(docs, items, 20))


def test_search_in_several_blocks_and_small_steps(spark, texts, monkeypatch):
    docs, items = texts
    monkeypatch.setattr(shared_terms, "BLOCK_PAIRS", 200)
    got = search_shared(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k=3)
    brute.same([tuple(r) for r in got.collect()], plain_search(docs, items, 3))


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} bigint, text string") for c in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert not search_shared(docs, one).collect() and not search_shared(docs, items).collect()
    assert not search_shared(one.withColumnRenamed("item_id", "doc_id"), items).collect()


def test_parts_add_up_to_the_items(texts):
    items = [terms_of((t or "").encode()) for _, t in texts[1]]
    shared = share(items)
    names = {j: w for w, j in shared.terms.items()}
    parts = [Counter() for _ in range(shared.parts)]
    for term, leaf, times in zip(shared.term_of, shared.leaf_of, shared.times_of, strict=True):
        parts[leaf][names[term]] += int(times)
    for i, (a, b) in enumerate(shared.sums, shared.leaves):
        assert a < i and b < i
        parts[i] = parts[a] + parts[b]
    for words_, at in zip(items, shared.items, strict=True):
        assert sum((parts[p] for p in at), Counter()) == Counter(words_)
    # every sum serves several items, and fewer sums are needed than without sharing
    serves = [set() for _ in range(shared.parts)]
    for i, at in enumerate(shared.items):
        for p in at:
            serves[p].add(i)
    for i in reversed(range(shared.leaves, shared.parts)):
        assert len(serves[i]) > 1
        for p in shared.sums[i - shared.leaves]:
            serves[p] |= serves[i]
    assert len(shared.sums) + sum(max(0, len(x) - 1) for x in shared.items) < sum(max(0, len(set(x)) - 1) for x in items)


def vectors_of(seed, n, dim=6, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * spread], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[5][1], 1) for i in range(8)]  # ties
    rows += [(None, rows[1][1], 1), (50 * n, None, 1), (50 * n + 100, [1.0] * (dim - 1) + [None], 1), (100, [float("nan")] * dim, 0), (200, [float("inf")] * dim, 0)]
    rows += [(0, rows[3][1], rows[3][2]), rows[4], (7 * n, [0.5, -0.5], 1), (100 * n, [0.25, 1.0], 1), (100 * n + 100, [], 2), (100 * n + 200, [], 2), (100 * n + 300, [1.0, 2.0], None)]
    return rows


def whole(rows):
    """(id, cells, label) of the rows that take part."""
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            yield i, [math.floor(256 * x) for x in v], label


def plain_top(rows, every, k):
    rows = list(whole(rows))
    for n, (q, v, _) in enumerate(rows):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w, _) in enumerate(rows) if m != n and len(w) == len(v))
            yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1))


def plain_negatives(rows, every, k):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in whole(rows) if label is not None]
    for n, (anchor, v, label) in enumerate(rows):
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i, other) for m, (i, w, other) in enumerate(rows) if m != n and len(w) == len(v))
        for p, positive, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p]
            yield from ((anchor, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fits[:k], 1))


VECTOR = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize(("size", "dim", "spread"), [(14, 6, 1.0), (6, 6, 1.0), (6, 40, 1.0), (6, 6, 1e4), (6, 3, 3e5)])
def test_vectors_equal_plain_versions(spark, monkeypatch, size, dim, spread):
    monkeypatch.setattr(vectors, "BLOCK", 1 << size)
    rows = vectors_of(dim, 400, dim, spread)
    df = spark.createDataFrame(rows, VECTOR).repartition(5).selectExpr("*", "1 AS key", "2 AS number", "3 AS slot", "'a' AS id", "4 AS dim")
    got = top_products(df, every=10, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    brute.same([tuple(r) for r in got.collect()], list(plain_top(rows, 10, 4)))
    got = hard_negatives(df, label=MOVED, every=20, k=4)
    brute.same([tuple(r) for r in got.collect()], list(plain_negatives(rows, 20, 4)))


def test_alike_vectors_and_lowered_thresholds(spark):
    # A third of the rows is one vector, and windows that fill only at the lowest threshold.
    rows = [(i, [1.0, 0.0, 0.0], 1) for i in range(0, 3000, 10)] + [(3001 + i, [0.81, i / 9000, 0.1], 2) for i in range(300)]
    df = spark.createDataFrame(rows, VECTOR)
    brute.same([tuple(r) for r in top_products(df, every=500).collect()], list(plain_top(rows, 500, 5)))
    brute.same([tuple(r) for r in hard_negatives(df, label=MOVED, every=500).collect()], list(plain_negatives(rows, 500, 5)))


def test_vectors_of_empty_tables(spark):
    for df in (spark.createDataFrame([], VECTOR), spark.createDataFrame([(None, None, None), (100, None, 1)], VECTOR)):
        assert not top_products(df).collect() and not hard_negatives(df).collect()
    assert [tuple(r) for r in top_products(spark.createDataFrame([(0, [1.0], 1), (1, [-1.0], 1)], VECTOR)).collect()] == [(0, 1, 1, -65536)]


def test_products_are_exact():
    big = np.array([[2**40, 3, -(2**20)], [1, 2, 3]])
    assert products(big, big[1:]).tolist() == [[2**40 + 6 - 3 * 2**20], [14]]
    with pytest.raises(OverflowError):
        products(np.full((1, 2), 2.0**60), np.full((1, 2), 2.0**60))


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(1)
    cells = np.zeros((4000, 32))
    cells[np.arange(4000), rng.integers(0, 32, 4000)] = rng.integers(1, 200, 4000)  # sparse rows: few of them matter for a query
    block = Block(0, np.arange(4000), np.zeros(4000, np.int64), cells)
    asked = block.asking(np.array([0]))
    tops = [Top(5)]
    read = search(Lists(block), asked, tops)
    assert read[0] < 400
    scores = cells @ cells[0]
    scores[0] = -1
    assert tops[0].scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    # a score that is known to be beaten by no row of the block: no list is read
    assert search(Lists(block), asked, [Top(5, int(scores.max()) + 1)])[0] == 0


def test_index_leaves_out_covered_dimensions():
    rng = np.random.default_rng(2)
    cells = np.floor(rng.normal(size=(500, 64)) * np.linspace(200, 1, 64))
    index = Inverted(Block(0, np.arange(500), np.zeros(500, np.int64), cells))
    asked = cells[:3]
    scores = asked @ cells.T
    thresholds = np.partition(scores, 490, axis=1)[:, 490]
    anchor, row = index.reaching(asked, thresholds)
    assert {(a, r) for a, r in zip(*np.nonzero(scores >= thresholds[:, None]), strict=True)} <= set(zip(anchor.tolist(), row.tolist(), strict=True))
    assert len(anchor) < scores.size / 4
