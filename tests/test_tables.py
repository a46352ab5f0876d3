"""Changes of keyed tables, filters, display and media listing."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import display, filters, tables, timeline
from foliant.sources import media, pages


@pytest.fixture()
def users(spark):
    return spark.createDataFrame(
        [(1, "ann", "admin"), (2, "bob", "user"), (3, "cy", None)], "id bigint, name string, role string"
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_insert(spark, users):
    fresh = spark.createDataFrame([("dan", "user", 2), ("eve", "user", 1)], "name string, role string, o int")
    table = users.withColumn("created", F.lit("old"))
    out = tables.insert_rows(table, "id", fresh, ["o"], "created", F.lit("new"))
    assert rows(out)[3:] == [(4, "eve", "user", "new"), (5, "dan", "user", "new")]


def test_insert_into_empty(spark, users):
    fresh = users.select("name", "role").where("name = 'ann'")
    out = tables.insert_rows(users.limit(0).withColumn("created", F.lit("x")), "id", fresh, ["name"], "created", F.lit("n"))
    assert rows(out) == [(1, "ann", "admin", "n")]


def test_unique_and_absent(spark, users):
    batch = spark.createDataFrame(
        [(10, "ann", "x"), (12, "new", "second"), (11, "new", "first")], "id bigint, name string, role string"
    )
    ok, rejected = tables.insert_unique(users, "name", batch, "id")
    assert rows(ok.select("id", "name")) == [(11, "new")]
    assert rows(rejected.select("id", "name")) == [(10, "ann"), (12, "new")]
    seeded = tables.insert_if_absent(users, "name", batch.where("id <> 12"))
    assert [r[1] for r in rows(seeded)] == ["ann", "new", "bob", "cy"]


def test_repeated_and_null_keys(spark, users):
    batch = spark.createDataFrame(
        [(10, "new", "a"), (10, "new", "a"), (11, "new", "b"), (12, None, "c"), (12, None, "c"), (13, "ann", "d")],
        "id bigint, name string, role string",
    )
    ok, rejected = tables.insert_unique(users, "name", batch, "id")
    assert sorted(map(tuple, ok.select("id", "role").collect())) == [(10, "a"), (12, "c"), (12, "c")]
    assert sorted(map(tuple, rejected.select("id", "role").collect())) == [(10, "a"), (11, "b"), (13, "d")]
    seeded = tables.insert_if_absent(users, "name", batch)
    assert seeded.count() == users.count() + 3
    assert rows(seeded.where("name = 'new'")) == [(10, "new", "a")]
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (2, "a", 3)], "id bigint, role string, o int")
    assert tables.update_by_id(users, "id", changes, ["o"]).where("id = 2").first()["role"] == "a"
    assert tables.update_by_id(users, "id", changes).count() == users.count()


def test_key_lookups_do_not_shuffle_the_large_table(spark):
    large = spark.range(200_000).withColumnRenamed("id", "k")
    probes = spark.createDataFrame([(5,), (None,), (300_000,)], "k bigint")
    found = filters.exists_key(probes, "k", large, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Range (0, 200000") == 1
    assert {(r["k"], r["found"]) for r in found.collect()} == {(5, True), (None, False), (300_000, False)}


def test_commit_replaces_what_it_reads(spark, users, tmp_path):
    base = str(tmp_path / "kept")
    assert tables.generations(spark, base) == []
    tables.commit(users, base)
    now = tables.commit(tables.update_by_id(tables.committed(spark, base), "id", users.limit(1).select("id", F.lit("z").alias("role"))), base)
    assert now.count() == users.count() and now.where("role = 'z'").count() == 1
    (tmp_path / "kept" / "generation-3").mkdir()
    assert tables.generations(spark, base) == [1, 2] and tables.committed(spark, base).where("role = 'z'").count() == 1


def test_update_delete_replace(spark, users):
    changes = spark.createDataFrame([(2, None), (9, "x")], "id bigint, role string")
    assert rows(tables.update_by_id(users, "id", changes)) == [(1, "ann", "admin"), (2, "bob", None), (3, "cy", None)]
    gone = spark.createDataFrame([(2,), (2,), (7,)], "id bigint")
    assert [r[0] for r in rows(tables.delete_by_key(users, "id", gone))] == [1, 3]
    assert rows(tables.affected_rows(users, "id", gone)) == [(2, 1, "deleted"), (7, 0, "not found")]
    fresh = spark.createDataFrame([(1, "a1", "g"), (1, "a2", "g")], "id bigint, name string, role string")
    once = tables.replace_group(users, "id", fresh)
    assert rows(once) == rows(tables.replace_group(once, "id", fresh)) and once.count() == 4


def test_overwrite_groups(spark, users, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite_groups(users.select("name", "role", "id"), "id", path)
    for _ in range(2):
        tables.overwrite_groups(users.where("id = 2").select("name", F.lit("new").alias("role"), "id"), "id", path)
    assert rows(spark.read.parquet(path).select("id", "role")) == [(1, "admin"), (2, "new"), (3, None)]


def test_ensure_and_truncate(spark, users, tmp_path):
    path = str(tmp_path / "ensured")
    tables.ensure_table(spark, "people", "id BIGINT, name STRING, role STRING", path)
    users.write.insertInto("people")
    tables.ensure_table(spark, "people", "id BIGINT, name STRING, role STRING", path)
    assert spark.table("people").count() == 3
    tables.truncate(spark, "people")
    assert spark.table("people").count() == 0
    spark.sql("DROP TABLE people")


def test_filters(spark, users):
    asked = spark.createDataFrame([(" 2 ",), ("x",), ("-1",), ("2.0",), ("99999999999999999999",)], "a string")
    assert [r[0] for r in rows(filters.get_by_id(users, "id", asked, "a"))] == [2]
    probes = spark.createDataFrame([("ann",), ("zed",)], "name string")
    assert rows(filters.exists_key(probes, "name", users, "name")) == [("ann", True), ("zed", False)]
    roles = spark.createDataFrame([(" Admin ",), ("root",), (None,)], "role string")
    assert rows(filters.allowed_values(roles, "role", ["admin", "user"])) == [
        ("admin", True), ("root", False), (None, False)
    ]


def test_marks(spark):
    df = spark.createDataFrame([("a [1] <b>hit</b> [bold x]",)], "t string")
    web = display.remap_marks(F.col("t"), ("<b>", "</b>"), ("*", "*"))
    rich = display.remap_marks(F.col("t"), ("<b>", "</b>"), ("[bold red]", "[/bold red]"))
    row = df.select(web, rich).first()
    assert row[0] == "a [1] *hit* [bold x]"
    assert row[1] == "a \\[1] [bold red]hit\\[/bold red] [bold x]"


def test_pages(spark):
    docs = spark.createDataFrame([(1, "a\fb\f"), (2, " \n\t"), (3, "")], "id bigint, t string")
    assert rows(pages.paginate(docs, "id", "t"))[:3] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "")]
    report = pages.extraction_report(pages.paginate(docs, "id", "t"))
    assert rows(report) == [(1, 3, 2, False), (2, 1, 0, True), (3, 1, 0, True)]


def test_list_media(spark, tmp_path):
    for name in ("f_10.jpg", "f_2.jpg", "b.png", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = media.list_media(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["ordinal"]) for r in got] == [("b.png", 1), ("f_10.jpg", 2), ("f_2.jpg", 3)]


def test_many_media_files_go_to_all_tasks(spark, data, tmp_path):
    import re
    from pathlib import Path

    import __spark_entry__ as contract
    from foliant.catalog.base import derived_path

    assert contract.queries()["a7_list_media"](spark, data).count() > 3
    written = [p.name for p in Path(derived_path(spark, data, "media")).rglob("part-*.txt")]
    assert len({re.match(r"part-(\d+)", n)[1] for n in written}) > 1  # a small table's scan would write all of them in one task
    (tmp_path / "a.jpg").write_bytes(b"x")
    assert "Coalesce" in media.list_media(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("max_inline", [64, 1])
def test_intervals_of_points_with_null_and_repeated_keys(spark, max_inline):
    keyed = [(None, 0.5), (None, 2.5), (None, 2.5), (None, 9.0), (1, 2.5), (1, 0.5), (1, None), (2, 1.5), (None, None)]
    points = spark.createDataFrame(keyed, "k bigint, t double")
    spans = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 3.0), (3, 2.0, 3.0), (4, 5.0, 5.0)], "idx int, start double, end double")
    wanted = {0.5: 1, 1.5: 2, 2.5: 2, 9.0: None, None: None}
    found = timeline.interval_lookup(points, "t", spans, max_inline)
    assert rows(found) == sorted(((k, t, wanted[t]) for k, t in keyed), key=str)
