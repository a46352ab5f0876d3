"""The stages on odd tables: ids that are null or repeated, columns with the operators' own names, short test items."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import recompression, suffixes
from foliant.llm.contamination import contaminated, without_contaminated
from foliant.llm.digests import without_exact_duplicates
from foliant.llm.neardup import near_duplicates, without_near_duplicates
from foliant.llm.suffixes import without_repeated_bytes

ODD = ["_id", "_kept", "_row_id", "_row_digest", "key", "row", "tag", "node", "component", "digest", "first"]


def with_odd_columns(df):
    return df.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(ODD)])


def shown(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


DOCS = [(1, "A b"), (2, "a B"), (2, "a B"), (3, None), (4, ""), (None, "a b"), (None, "only here"), (None, "only here"), (2, "other")]


def test_exact_stage(spark):
    df = with_odd_columns(spark.createDataFrame(DOCS, "doc_id bigint, text string"))
    got = without_exact_duplicates(df)
    assert got.columns == df.columns and {r["_id"] for r in got.collect()} == {"v0"}
    assert shown(got) == sorted([(2, "a B"), (4, ""), (None, "only here"), (2, "other")], key=str)
    assert not without_exact_duplicates(df.limit(0)).collect()


def test_near_stage_keeps_one_of_each_component(spark):
    base = " ".join(f"word{i}" for i in range(60))
    near = [base + f" end{i}" for i in range(3)]
    other = " ".join(f"else{i}" for i in range(40))
    rows = [(None, near[0]), (None, near[1]), (None, near[2]), (None, ""), (7, None), (8, " "), (5, other), (5, other), (9, other + " x"), (5, "short text")]
    df = with_odd_columns(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = shown(without_near_duplicates(df))
    assert sum(t in near for _, t in got) == 1
    assert [x for x in got if x[1] not in near] == sorted([(None, ""), (7, None), (8, " "), (5, other), (5, "short text")], key=str)
    assert near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert not without_near_duplicates(df.limit(0)).collect()


def test_short_items_match_as_whole_words(spark):
    items = [("q1", "What is two plus two?"), ("q2", "two"), ("q3", "!?"), ("q4", None), (None, "four"), ("q5", "日本"), ("q6", "this one is long enough to be found with some edits in it")]
    docs = [(1, "So: what is TWO plus two? Four."), (2, "network twofold"), (3, "two"), (4, "a 日本 b"), (5, "日本語"), (6, "here this one is long enogh to be found with some edits in it, yes"), (7, None), (8, "")]
    i = spark.createDataFrame(items, "item_id string, text string").withColumn("distance", F.lit(1))
    d = with_odd_columns(spark.createDataFrame(docs, "doc_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(d, i).collect()}
    assert found == {(1, "q1", 0), (1, "q2", 0), (3, "q2", 0), (4, "q5", 0), (6, "q6", 1)}
    assert {r["doc_id"] for r in without_contaminated(d, i).collect()} == {2, 5, 7, 8}
    assert without_contaminated(d, i.limit(0)).count() == len(docs) and not contaminated(d.limit(0), i).collect()


def test_blocks_of_items(spark, monkeypatch):
    from foliant.llm import contamination

    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, f"item number {i} with words of its own {i * 7}") for i in range(7)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"x item number {i} with words of its own {i * 7} y") for i in range(12)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items, rate=0.0).collect()} == {(i, i) for i in range(7)}
    assert {r["doc_id"] for r in without_contaminated(docs, items, rate=0.0).collect()} == set(range(7, 12))


def test_too_wide_windows_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="width"):
        without_repeated_bytes(docs, width=8000)
    rnd = random.Random(1)
    shared = "".join(rnd.choices("abcdefgh ", k=9000))
    wide = spark.createDataFrame([(1, "a" + shared), (2, "b" + shared), (3, "c" * 100)], "doc_id bigint, text string")
    assert {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in without_repeated_bytes(wide, width=suffixes.WIDEST).collect()} == {1: 9000, 2: 9000, 3: 0}


def test_two_word_digests_are_independent():
    names, checks = recompression.named_and_checked("a b a  c\nä".encode())
    assert len(names) == len(checks) == 5 and names[0] == names[2] and checks[0] == checks[2]
    assert len(set(names.tolist()) | set(checks.tolist())) == 8
