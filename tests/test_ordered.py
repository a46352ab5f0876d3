"""Windows over groups cut into blocks give the same rows as plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import context, listings, timeline
from foliant.plans.ordered import ordered
from foliant.plans import sizing


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one key, equal times, NULL keys and NULL values."""
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rnd.randint(0, 20)}")
        rows.append((i, key, rnd.randint(0, 60), rnd.choice([None, None, f"v{i}"])))
    return spark.createDataFrame(rows, "id int, k string, t int, v string").cache()


def both(skewed, fn):
    plain = ordered(skewed, ["k"], ["t", "id"])
    cut = ordered(skewed, ["k"], ["t", "id"], rows_per_block=40)
    assert not plain.split and cut.split
    assert cut.df.select("_blk").distinct().count() > 10
    a, b = fn(plain).rows(), fn(cut).rows()
    assert a.columns == b.columns
    a, b = ({tuple(r) for r in df.collect()} for df in (a, b))
    assert a == b and len(a) == 900


def test_number(skewed):
    both(skewed, lambda o: o.number("n", "total"))


def test_carry(skewed):
    both(skewed, lambda o: o.carry("v", "last", F.lit("none")))


def test_neighbours(skewed):
    both(skewed, lambda o: o.neighbours("v", "p", "n"))


def test_no_key(skewed):
    cut = ordered(skewed, [], ["t", "id"], rows_per_block=100).number("n", "total").rows()
    got = [tuple(r) for r in cut.orderBy("t", "id").select("n", "total").collect()]
    assert got == [(i + 1, 900) for i in range(900)]


def test_listing_pages(skewed):
    keyed = skewed.where("k is not null").withColumn("name", F.lit("x"))
    pages = listings.render_listing(keyed, ["k"], "id", "name", "%d: %s", page_rows=7)
    assert pages.agg(F.max("n_lines")).first()[0] == 7
    text = "\n".join(r["listing"] for r in pages.where("k = 'hot'").orderBy("listing_page").collect())
    assert text == "\n".join(f"{i}: x" for i in range(0, 900, 3))


@pytest.mark.parametrize("block", [10**9, 40])
def test_context(spark, skewed, block):
    log = skewed.withColumn("ask", F.col("id") % 4 == 0).withColumn(
        "prompt", F.when(F.col("id") % 8 == 0, "BASED on it").otherwise("else")
    )
    found = F.when(~F.col("ask"), F.col("v"))
    got = context.attach_last_search(
        log, "k", ["t", "id"], F.col("ask"), found, F.col("prompt"), rows_per_block=block
    )
    got = {r["id"]: r["last_search"] for r in got.collect()}
    last, expected = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["t"], r["id"])):
        if r["ask"]:
            expected[r["id"]] = last.get(r["k"]) if "BASED" in r["prompt"] else None
        elif r["v"]:
            last[r["k"]] = r["v"]
    assert got == expected


def brute_samples(rows, key_of, start, duration, n, fps):
    groups = {}
    for r in rows:
        groups.setdefault(key_of(r), []).append(r["id"])
    out = []
    for key, ids in groups.items():
        first, last = int(start * fps), min(int((start + duration) * fps), len(ids))
        for i in range(n):
            at = int(first + i * (last - first) / max(n - 1, 1))
            if 0 <= at < len(ids):
                out.append((key, i + 1, at, ids[at]))
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 4, 9])
@pytest.mark.parametrize("block", [10**9, 40])
def test_sample_even_rows(skewed, n, block):
    keyed = skewed.where("k is not null")
    rows = sorted(keyed.collect(), key=lambda r: (r["t"], r["id"]))
    got = timeline.sample_even_rows(
        keyed, ["k"], ["t", "id"], start=2.0, duration=20.0, n=n, fps=1.5, rows_per_block=block
    ).collect()
    mine = sorted((r["k"], r["sample_no"], r["frame_number"], r["id"]) for r in got)
    assert mine == brute_samples(rows, lambda r: r["k"], 2.0, 20.0, n, 1.5)


def test_even_timestamps(skewed):
    got = timeline.even_timestamps(skewed.where("k = 'hot'"), ["k"], ["t", "id"]).orderBy("t", "id").collect()
    assert [r["timestamp_sec"] for r in got] == pytest.approx([round(i * (10.0 / 299), 1) for i in range(300)], abs=0.1001)
    single = timeline.even_timestamps(skewed.limit(1), ["k"], ["t", "id"]).first()
    assert single["timestamp_sec"] == 0.0


@pytest.mark.parametrize("n", [1, 4, 7])
def test_sample_midpoints(spark, skewed, n):
    keyed = skewed.where("k is not null").withColumn("s", F.col("t").cast("double"))
    got = timeline.sample_midpoints(keyed, ["k"], "s", "id", F.lit(5.0), 70.0, n).collect()
    mine = sorted((r["k"], r["sample_no"], r["s"], r["id"]) for r in got)
    expected, groups = [], {}
    for r in keyed.collect():
        groups.setdefault(r["k"], []).append((r["s"], r["id"]))
    for key, rows in groups.items():
        for i in range(n):
            target = 5.0 + i * (70.0 / n) + 70.0 / (2 * n)
            later = [x for x in rows if x[0] >= target]
            if later:
                expected.append((key, i + 1, *min(later)))
    assert mine == sorted(expected)


@pytest.mark.parametrize("inline", [1000, 0])
def test_interval_lookup(spark, inline):
    rnd = random.Random(5)
    points = [(i, rnd.uniform(-20, 120)) for i in range(400)] + [(400, 10.0), (401, 20.0)]
    spans = [(0, 10.0, 20.0), (1, 5.0, 12.0), (2, -3.5, -3.25), (3, 40.0, 40.0), (4, 0.0, 100.0)]
    spans += [(5 + i, a, a + rnd.choice([0.01, 0.5, 3, 30])) for i, a in enumerate(rnd.uniform(-30, 110) for _ in range(60))]
    p = spark.createDataFrame(points, "id int, t double")
    s = spark.createDataFrame(spans, "idx int, start double, end double")
    got = {r["id"]: r["idx"] for r in timeline.interval_lookup(p, "t", s, max_inline=inline).collect()}
    assert got == {i: min((x for x, a, b in spans if a <= t < b), default=None) for i, t in points}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_beyond_the_bound(spark, skewed, how):
    dim = spark.createDataFrame([("hot",), ("k3",), ("zz",)], "k string")
    small = sizing.lookup_join(skewed, dim, ["k"], how)
    salted = sizing.lookup_join(skewed, dim, ["k"], how, max_rows=1, salts=5)
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.select(small.columns).collect()))


def test_link_media(spark):
    media = spark.createDataFrame(
        [(1, f"static/a/frame_{i}.jpg") for i in (1, 2, 10)] + [(2, "static/b/x.png"), (3, "c.jpg")],
        "link_id int, path string",
    )
    docs = spark.createDataFrame([(1, 11), (2, 22)], "link_id int, document_id int")
    got = [tuple(r)[1:] for r in timeline.link_media(docs, media).orderBy("link_id", "frame_path").collect()]
    assert got == [
        (11, "static/a/frame_1.jpg", 0.0),
        (11, "static/a/frame_10.jpg", 5.0),
        (11, "static/a/frame_2.jpg", 10.0),
        (22, "static/b/x.png", 0.0),
    ]


@pytest.mark.parametrize(("n", "block"), [(10, 2_000_000), (70, 2_000_000), (3000, 2_000_000), (3000, 500)])
def test_open_nested_and_equal_intervals(spark, monkeypatch, n, block):
    monkeypatch.setattr(timeline, "ordered", lambda *a, **k: ordered(*a, rows_per_block=block, **k))
    rnd, inf = random.Random(n), float("inf")
    spans = [(n, -inf, 50.0), (n + 1, 60.0, inf), (n + 2, 0.0, None), (n + 3, None, 9.0), (n + 4, 5.0, 5.0), (n + 5, 9.0, 3.0)]
    for i in range(n):
        a = round(rnd.uniform(0, 100), 1)
        spans.append((i if i % 3 else n + 10 + i, a, rnd.choice([a + 0.1, a + 5, 80.0, a + 30])))
    spans += spans[6:9]  # equal ones
    points = [(i, rnd.choice([round(rnd.uniform(-5, 120), 1), inf, -inf, float("nan"), None])) for i in range(1500)]
    got = timeline.interval_lookup(spark.createDataFrame(points, "id int, t double"), "t", spark.createDataFrame(spans, "idx int, start double, end double"))
    real = [(x, a, b) for x, a, b in spans if a is not None and b is not None and a < b]
    wanted = {i: min((x for x, a, b in real if a <= t < b), default=None) if t is not None and t == t else None for i, t in points}
    assert {r["id"]: r["idx"] for r in got.collect()} == wanted


def test_sampling_numbers_few_rows_of_a_large_key(spark, monkeypatch):
    n = 20_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), "id", F.timestamp_seconds(F.col("id") * 60 % (n * 60)).alias("t"), F.when(F.col("id") > 5, F.col("id")).alias("maybe"))
    numbered = []
    plain = ordered

    def counted(df, *a, **k):
        numbered.append(df.count())
        return plain(df, *a, **k)

    monkeypatch.setattr(timeline, "ordered", counted)
    for first, kind in (("t", "timestamp"), ("maybe", "bigint")):
        numbered.clear()
        got = timeline.sample_even_rows(rows, ["k"], [first, "id"], 100.0, 9_000.0, 9, 1.0, rows_per_block=1000)
        assert sorted((r["sample_no"], r["id"]) for r in got.collect()) == [(i + 1, 100 + i * 1125) for i in range(9)]
        assert numbered[0] < n / 100
    few = timeline.sample_even_rows(rows, ["k"], ["t", "id"], 0.0, 1e9, 3, 1.0, rows_per_block=1000)
    assert sorted((r["sample_no"], r["id"]) for r in few.collect()) == [(1, 0), (2, n // 2)]  # the last is past the end
