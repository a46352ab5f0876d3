"""Physical plans: what must not be shuffled, and what must be cut before it is."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from foliant.plans import sizing

QUERIES = contract.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["f1_tokenize", "a1_paginate", "j1_interval_lookup", "r3_frame_token_stream", "s3_strip_tags", "p4_filter_types"]
)
def test_row_work_needs_no_hash_shuffle(spark, data, name):
    assert "Exchange hashpartitioning" not in plan(QUERIES[name](spark, data))


def test_postings_need_no_shuffle(spark, data):
    from foliant.sources.index import build_postings, tokenize_pages
    from foliant.sources.pages import whole_pages

    docs = spark.read.parquet(f"{data}/documents.parquet")
    postings = build_postings(tokenize_pages(whole_pages(docs, "doc_id", "text")))
    assert "Exchange" not in plan(postings)


@pytest.mark.parametrize("name", ["f11_search_ranked", "f12_search_first_n", "r2_rate_limit"])
def test_first_rows_are_cut_before_the_shuffle(spark, data, name):
    assert plan(QUERIES[name](spark, data)).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["p4_filter_types", "w5_prev_next", "j3_attach_last_search"])
def test_scans_read_only_used_columns(spark, data, name):
    scan = next(line for line in plan(QUERIES[name](spark, data)).splitlines() if "FileScan" in line)
    assert "props" not in scan.split("ReadSchema")[1] or name == "j3_attach_last_search"
    assert "l_shipdate" not in scan


@pytest.mark.parametrize("name", ["t6_delete_by_key", "j1_interval_lookup_many", "f18_whole_table_match", "j4_route_commands"])
def test_no_nested_loops_even_beyond_the_bounds(spark, data, name, monkeypatch):
    monkeypatch.setattr(sizing, "is_small", lambda *a, **k: False)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, data)
        text, salted = plan(df), sorted(map(str, df.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    monkeypatch.undo()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert salted == sorted(map(str, QUERIES[name](spark, data).collect()))


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("y" * 50)).alias("a"))
    assert sizing.is_small(wide) and not sizing.is_small(wide, max_bytes=5_000)
    assert not sizing.is_small(wide, max_rows=9)


def test_small_inputs_are_spread_and_large_ones_left(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert sizing.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sizing, "SPLIT_BYTES", 1)
    assert sizing.spread(docs) is docs


@pytest.mark.parametrize("name", ["g2_affected_rows", "p3_exists_key", "p2_get_by_id", "t3_insert_if_absent"])
def test_salted_sides_are_not_broadcast(spark, data, name, monkeypatch):
    monkeypatch.setattr(sizing, "is_small", lambda *a, **k: False)
    assert "Broadcast" not in plan(QUERIES[name](spark, data))
