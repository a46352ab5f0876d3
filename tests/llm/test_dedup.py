import random

import brute
import pytest
from pyspark.sql import functions as F

from foliant.llm.digests import add_batch, digested, exact_duplicates, open_index, without_exact_duplicates
from foliant.llm.neardup import components, near_duplicates, without_near_duplicates
from foliant.llm.recompression import without_later_passages
from foliant.llm.suffixes import without_repeated_bytes
from foliant.plans.sizing import scratch_path

SCHEMA = "doc_id bigint, text string"
HARD = [None, "", "  \n", "one", "ONE", "one", "É one", "é one", "a" * 500, "ab" * 300, "a b " * 150, "x"]


def of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_duplicates_of_hard_rows(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(HARD * 3)]
    brute.same(tuples(exact_duplicates(of(spark, rows)), *EXACT), brute.exact(rows))
    assert exact_duplicates(of(spark, [])).count() == 0


def test_extra_columns_with_names_of_the_operator_do_no_harm(spark):
    rows = [(1, "a b c"), (2, "A b c"), (3, None)]
    docs = of(spark, rows).selectExpr("*", "'x' AS digest", "7 AS n", "1 AS tag", "0 AS node", "2 AS keep_id", "'k' AS kept", "5 AS found")
    brute.same(tuples(exact_duplicates(docs), *EXACT), brute.exact(rows))
    kept = without_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    near = without_near_duplicates(docs)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {1, 3}
    assert without_repeated_bytes(docs).count() == 3 and without_later_passages(docs).count() == 3


def test_index_lives_on_and_a_batch_may_be_added_twice(spark):
    index = open_index(spark, scratch_path(spark, "test-index"), buckets=4)
    first, second = of(spark, [(1, "a"), (2, "A"), (3, "b")]), of(spark, [(10, "a"), (11, "c"), (12, "C")])
    assert {r.keep_id for r in exact_duplicates(first, index=index, batch="one").collect()} == {2, 3}
    again = {r.doc_id: (r.keep_id, r.kept) for r in exact_duplicates(second, index=index, batch="two").collect()}
    assert again == {10: (2, False), 11: (12, False), 12: (12, True)}
    add_batch(index, digested(second), "two")
    assert index.rows().count() == 3
    plan = digested(first).join(index.rows(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_leave_one(spark):
    docs = of(spark, [(1, "a"), (1, "a"), (None, "q"), (None, "q"), (2, "b")])
    assert sorted(str(r.doc_id) for r in without_exact_duplicates(docs).collect()) == ["1", "2", "None"]


def varied(seed, n, alphabet, sizes, edits):
    rng = random.Random(seed)
    base = [[rng.choice(alphabet) for _ in range(size)] for size in sizes]
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice(edits)):
            if words:
                words[rng.randrange(len(words))] = "z" + str(rng.randrange(9))
        cut = rng.randrange(len(words) + 1) if rng.random() < 0.2 else 0
        yield rng.choice([" ", "  ", "\n", "\t"]).join(words[cut:] + words[:cut])


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, words, percent):
    texts = HARD + list(varied(7, 300, [c + str(i) for c in "abcdefgh" for i in range(40)], (3, 8, 15, 40, 100, 300), [0, 0, 1, 1, 2, 4, 8]))
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = [(None if i % 50 == 3 else i, t) for i, t in zip(ids, texts, strict=True)]
    brute.same(tuples(near_duplicates(of(spark, rows), words=words, percent=percent), *NEAR), brute.near(rows, words, percent))


def test_near_duplicates_of_a_family_whose_copies_are_no_links_of_each_other(spark):
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 4, 6])):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    brute.same(tuples(near_duplicates(of(spark, rows), words=3, percent=85), *NEAR), brute.near(rows, 3, 85))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(of(spark, [])).count() == 0
    assert sorted(tuples(near_duplicates(of(spark, [(1, None), (2, "")])), *NEAR)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.expr("id * 7 % 61").alias("a"), F.expr("(id + 1) * 7 % 61").alias("b"))
    found = components(edges)
    assert found.count() == 61 and {r.component for r in found.collect()} == {0}


def bytes_of(df):
    gone = "aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"
    return [tuple(r) for r in df.selectExpr("doc_id", "n_bytes", gone, "size(spans)", "sha2(kept, 256)").collect()]


def pieces(seed, n, alphabet, longest, joiner):
    rng = random.Random(seed)
    base = [[rng.choice(alphabet) for _ in range(rng.randrange(longest))] for _ in range(8)]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            at = rng.randrange(len(b) + 1)
            parts += b[at : at + rng.randrange(longest)]
        if parts and rng.random() < 0.5:
            parts[rng.randrange(len(parts))] = "Z"
        yield joiner.join(parts)


@pytest.mark.parametrize("width", [200, 60, 32])
def test_repeated_bytes_against_all_strings(spark, width):
    texts = HARD + list(pieces(width, 50, "abcdé ", 2 * width, ""))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts + texts[20:24])]
    brute.same(bytes_of(without_repeated_bytes(of(spark, rows), width=width)), brute.repeated_bytes(rows, width))


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    from foliant.llm import suffixes

    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    texts = [long.encode(), (long[7_000:9_000] + "x" + long[:5_000]).encode()]
    whole = suffixes.runs_of(texts)
    monkeypatch.setattr(suffixes, "SEGMENT", 4_000)
    windows = set()
    for numbers, offsets, parts in suffixes._segments(texts, 200):
        number, start, count, _, _, _ = suffixes.runs_of(parts)
        windows |= {(numbers[n], offsets[n] + s + k) for n, s, c in zip(number, start, count, strict=True) for k in range(c)}
    assert windows == {(n, s + k) for n, s, c in zip(*whole[:3], strict=True) for k in range(c)}


@pytest.mark.parametrize(("width", "alphabet"), [(50, [str(i) for i in range(900)]), (20, list("abcd")), (12, list("ab")), (1, list("abcdefg"))])
def test_later_passages_against_all_windows(spark, width, alphabet):
    texts = HARD + list(pieces(width, 60, alphabet, 2 * width + 2, " "))
    ids = list(range(len(texts) + 4))
    random.Random(2).shuffle(ids)
    rows = [(None if i % 9 == 0 else i, t) for i, t in zip(ids, texts + texts[12:16], strict=True)]
    rows += [(7, texts[20]), (7, texts[21])]
    brute.same(tuples(without_later_passages(of(spark, rows), width=width), "doc_id", "n_words", "n_removed", F.sha2("kept", 256)), brute.later_passages(rows, width))


def test_nothing_to_find_in_empty_tables(spark):
    assert without_repeated_bytes(of(spark, [])).count() == 0
    assert without_later_passages(of(spark, [])).count() == 0
