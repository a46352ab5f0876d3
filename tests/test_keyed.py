"""Tables in buckets: what a change writes, what it leaves alone, and two changes at once."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import tables
from foliant.operators.keyed import Conflict, create_keyed, open_keyed

N = 200


@pytest.fixture
def base(spark, tmp_path):
    rows = spark.range(N).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, "none")], "k bigint, v string"))
    create_keyed(rows, str(tmp_path / "t"), "k", 16)
    return str(tmp_path / "t")


def found(table):
    return sorted(((r["k"], r["v"]) for r in table.rows().collect()), key=str)


def plain(**changed):
    rows = {**{i: f"v{i}" for i in range(N)}, None: "none"}
    rows.update({int(k[1:]): v for k, v in changed.items()})
    return sorted(((k, v) for k, v in rows.items() if v is not ...), key=str)


def test_changes(spark, base):
    t = open_keyed(spark, base)
    assert t.version == 1 and found(t) == plain()
    new = spark.createDataFrame([(3, "new"), (5, "new"), (9999, "no such key")], "k bigint, v string")
    t = t.change(new, lambda part: tables.update_by_id(part, "k", new))
    assert found(t) == found(open_keyed(spark, base)) == plain(k3="new", k5="new")
    t = t.change(new, lambda part: tables.delete_by_key(part, "k", new))
    assert found(t) == plain(k3=..., k5=...)
    t = t.add_absent(spark.createDataFrame([(3, "back"), (7, "not taken"), (500, "b"), (500, "a")], "k bigint, v string"))
    assert found(open_keyed(spark, base)) == plain(k3="back", k5=..., k500="a") and t.version == 4
    assert found(open_keyed(spark, base, 1)) == plain()  # earlier versions stay
    with pytest.raises(FileNotFoundError):
        open_keyed(spark, base, 9)


def test_untouched_buckets_keep_their_files(spark, base):
    t = open_keyed(spark, base)
    one = spark.createDataFrame([(3, "x")], "k bigint, v string")
    (bucket,) = t.touched(one)
    read = []

    def next_state(part):
        read.append(part.count())
        return tables.update_by_id(part, "k", one)

    after = t.change(one, next_state)
    assert read[0] < N / 4  # only the key's bucket was read
    assert {b for b in after.folders if after.folders[b] != t.folders[b]} == {bucket}
    added = after.append(one)
    assert all(set(after.folders[b]) <= set(added.folders[b]) for b in after.folders)
    assert {b for b in added.folders if added.folders[b] != after.folders[b]} == {bucket}
    plan = t.rows([bucket])
    assert all(f"bucket={bucket}/" in f for f in plan.inputFiles())


def test_of_two_changes_at_once_one_fails(spark, base):
    one, two = open_keyed(spark, base), open_keyed(spark, base)
    gone = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k bigint")
    one.change(gone(1), lambda part: tables.delete_by_key(part, "k", gone(1)))
    with pytest.raises(Conflict):
        two.change(gone(2), lambda part: tables.delete_by_key(part, "k", gone(2)))
    assert found(open_keyed(spark, base)) == plain(k1=...)
    again = open_keyed(spark, base)
    again.change(gone(2), lambda part: tables.delete_by_key(part, "k", gone(2)))
    assert found(open_keyed(spark, base)) == plain(k1=..., k2=...)


def test_odd_changes(spark, base):
    t = open_keyed(spark, base)
    nothing = spark.createDataFrame([], "k bigint")
    assert t.change(nothing, lambda part: part) is t
    with pytest.raises(ValueError, match="not about"):
        t.change(spark.createDataFrame([(1,)], "k bigint"), lambda part: spark.range(N).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    none = spark.createDataFrame([(None,)], "k bigint")
    t = t.change(none, lambda part: part.where("k IS NOT NULL"))
    every = t.rows().select("k")
    t = t.change(every, lambda part: part.limit(0))
    assert t.rows().count() == 0 and open_keyed(spark, base).rows().columns == ["k", "v"]
    assert t.append(spark.createDataFrame([(1, "again")], "k bigint, v string")).rows().count() == 1
