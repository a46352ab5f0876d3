"""Throttling and token streams: batch against brute force, blocks and streams against batch."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.streaming import throttle, tokens
from foliant.streaming.sessions import session_last_search


@pytest.fixture(scope="module")
def requests(spark):
    rnd = random.Random(11)
    rows, now = [], 1_700_000_000_000_000
    for i in range(600):
        now += rnd.choice([0, 300_000, 1_000_000, 2_500_001, 4_000_000])
        rows.append((i, "hot" if i % 3 else rnd.choice("abcd"), now))
    df = spark.createDataFrame(rows, "id int, k string, s bigint")
    return df.select("id", "k", F.timestamp_micros("s").alias("ts"), "s").cache()


def brute_cooldown(rows, gap):
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["s"], r["id"])):
        us = r["s"]
        wait = 0 if r["k"] not in last else gap * 1_000_000 - (us - last[r["k"]])
        if wait > 0:
            out[r["id"]] = (False, wait // 1_000_000 + 1)
        else:
            last[r["k"]] = us
            out[r["id"]] = (True, None)
    return out


@pytest.mark.parametrize("block", [10**9, 30, 7])
@pytest.mark.parametrize("gap", [1, 5, 60])
def test_cooldown(requests, block, gap):
    got = throttle.cooldown(requests, ["k"], "ts", "id", gap, rows_per_block=block).collect()
    assert {r["id"]: (r["accepted"], r["retry_after"]) for r in got} == brute_cooldown(requests.collect(), gap)


def brute_limit(rows, n, length, anchored):
    start, count, kept = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r["s"], r["id"])):
        k, us = r["k"], r["s"]
        if k not in start or us >= start[k] + length:
            start[k], count[k] = (us if anchored else us // length * length), 0
        count[k] += 1
        if count[k] <= n:
            kept.add(r["id"])
    return kept


def test_rate_limits(requests):
    rows, minute = requests.collect(), 60_000_000
    aligned = throttle.rate_limit(requests, ["k"], "ts", "id", 5, "minute")
    assert {r["id"] for r in aligned.collect()} == brute_limit(rows, 5, minute, False)
    for block in (10**9, 30):
        anchored = throttle.rate_limit_anchored(requests, ["k"], "ts", "id", 5, "minute", rows_per_block=block)
        assert {r["id"] for r in anchored.collect()} == brute_limit(rows, 5, minute, True)


def test_thirty_a_minute_rejects_some_of_35(spark):
    rows = spark.range(35).select("id", F.lit("x").alias("k"), F.timestamp_micros(F.col("id") * 10_000).alias("ts"))
    assert throttle.rate_limit(rows, ["k"], "ts", "id", 30, "minute").count() == 30


def streamed(spark, tmp_path, df, build, parts=4, order="s"):
    """Feed ``df`` in several micro-batches in time order and return the output rows."""
    rows = df.orderBy(order, "id")
    numbered = rows.withColumn("_part", F.ntile(parts).over(Window.orderBy(order, "id")))
    source = tmp_path / "in"
    for p in range(1, parts + 1):
        numbered.where(f"_part = {p}").drop("_part").coalesce(1).write.mode("append").parquet(str(source))
    stream = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    )
    out = build(stream)
    query = (
        out.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    streamed.last = query.lastProgress
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def state_left():
    """Keys and bytes of state at the end of the latest stream."""
    (operator,) = streamed.last.stateOperators
    return operator.numRowsTotal, operator.memoryUsedBytes


def with_later_rows(spark, df):
    """Two rows of another key, each days later, so that the watermark passes everything before."""
    late = [(9001 + i, "late", 1_800_000_000_000_000 + i * 10**13) for i in range(2)]
    rows = spark.createDataFrame(late, "id int, k string, s bigint")
    return df.unionByName(rows.select("id", "k", F.timestamp_micros("s").alias("ts"), "s"))


def test_cooldown_stream(spark, requests, tmp_path):
    got = streamed(spark, tmp_path, requests, lambda s: throttle.cooldown_stream(s, ["k"], "ts", "id", 5))
    assert {r["id"]: (r["accepted"], r["retry_after"]) for r in got} == brute_cooldown(requests.collect(), 5)


@pytest.mark.parametrize("anchored", [False, True])
def test_rate_limit_stream(spark, requests, tmp_path, anchored):
    got = streamed(
        spark, tmp_path, requests,
        lambda s: throttle.rate_limit_stream(s, ["k"], "ts", "id", 5, "minute", anchored),
    )
    assert {r["id"] for r in got} == brute_limit(requests.collect(), 5, 60_000_000, anchored)


def test_session_stream(spark, requests, tmp_path):
    log = requests.select("id", "k", "ts", "s", (F.col("id") % 3 == 0).alias("ask"))
    found = F.when((F.col("id") % 3 != 0) & (F.col("id") % 5 != 0), F.concat(F.lit("f"), F.col("id")))
    prompt = F.when(F.col("id") % 2 == 0, "Based on").otherwise("x")
    got = streamed(
        spark, tmp_path, log,
        lambda s: session_last_search(s, "k", "ts", "id", F.col("ask"), found, prompt),
    )
    last, expected = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["s"], r["id"])):
        if r["ask"]:
            expected[r["id"]] = last.get(r["k"]) if r["id"] % 2 == 0 else None
        elif r["id"] % 5:
            last[r["k"]] = f"f{r['id']}"
    assert {r["id"]: r["last_search"] for r in got} == expected


FRAMES = [
    ("a", ["Hel", "lo\n", " wor", "ld", None], None, "Hello\n world", "done"),
    ("b", ["x", None], "gone", "x\n[ERROR] gone", "error"),
    ("c", [None], None, "", "done"),
    ("d", ["lost", " end"], None, "lost end", "lost"),
]


def frames_of(spark):
    rows = [(s, i, c, e) for s, chunks, e, _, _ in FRAMES for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "stream string, seq int, chunk string, err string")
    return tokens.frame_token_stream(df, "chunk", "err")


def test_frames(spark):
    got = {(r["stream"], r["seq"]): r["frame"] for r in frames_of(spark).collect()}
    assert got[("a", 1)] == "data: lo\\n\n\n"
    assert got[("a", 4)] == "data: [DONE]\n\n"
    assert got[("b", 1)] == "data: [ERROR] gone\n\n"


@pytest.mark.parametrize("segment", [10_000, 2, 1])
def test_assemble(spark, segment):
    late = spark.createDataFrame([("a", 5, "data: late\n\n"), ("a", 6, "data: [DONE]\n\n")], "stream string, seq int, frame string")
    frames = frames_of(spark).select("stream", "seq", "frame").unionByName(late).repartition(5)
    got = tokens.assemble_token_stream(frames, "stream", "seq", "frame", segment).collect()
    parts = {}
    for r in sorted(got, key=lambda r: (r["stream"], r["part"])):
        text, _ = parts.get(r["stream"], ("", ""))
        parts[r["stream"]] = (text + r["text"], r["status"])
    assert parts == {s: (t, st) for s, _, _, t, st in FRAMES}


def test_assemble_stream(spark, tmp_path):
    rows = frames_of(spark).where("stream <> 'd' or seq < 2").withColumn("id", F.col("seq"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60)
    rows = rows.select("stream", "seq", "frame", "id", at.alias("ts"), F.col("seq").cast("double").alias("s"))
    tail = spark.createDataFrame([("z", 0, "data: [DONE]\n\n", 9, 9.0)], "stream string, seq int, frame string, id int, s double")
    late = F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts")
    tail = tail.select("stream", "seq", "frame", "id", late, "s")
    end = tail.select(F.lit("y").alias("stream"), "seq", "frame", F.lit(10).alias("id"), F.timestamp_seconds(F.lit(1_700_200_000)).alias("ts"), F.lit(10.0).alias("s"))
    got = streamed(
        spark, tmp_path, rows.unionByName(tail).unionByName(end),
        lambda s: tokens.assemble_stream(s, "stream", "seq", "frame", "ts", "10 minutes"), parts=6,
    )
    assert {(r["stream"], r["text"], r["status"]) for r in got} == {
        (s, t, st) for s, _, _, t, st in FRAMES
    } | {("z", "", "done"), ("y", "", "done")}


@pytest.mark.parametrize("segment", [10_000, 2, 1])
def test_a_missing_frame_loses_the_stream_in_both_forms(spark, tmp_path, segment):
    rows = [("g", 0, "a"), ("g", 2, "c"), ("g", 3, "[DONE]"), ("w", 0, "x"), ("w", 1, "[DONE]"), ("w", 2, "late"), ("n", 1, "p"), ("n", 2, "[DONE]")]
    frames = spark.createDataFrame([(s, n, f"data: {p}\n\n", n) for s, n, p in rows], "stream string, seq int, frame string, id int")
    batch = {}
    for r in sorted(tokens.assemble_token_stream(frames, "stream", "seq", "frame", segment).collect(), key=lambda r: (r["stream"], r["part"])):
        batch[r["stream"]] = (batch.get(r["stream"], ("",))[0] + r["text"], r["status"])
    assert batch == {"g": ("ac", "lost"), "w": ("x", "done"), "n": ("p", "lost")}
    if segment == 2:
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60).alias("ts")
        rows = frames.select("stream", "seq", "frame", "id", at, F.col("seq").cast("double").alias("s"))
        for i in (1, 2):
            late = F.timestamp_seconds(F.lit(1_700_000_000 + i * 100_000)).alias("ts")
            tail = spark.createDataFrame([(f"z{i}", 0, "data: [DONE]\n\n", 8 + i, 8.0 + i)], "stream string, seq int, frame string, id int, s double")
            rows = rows.unionByName(tail.select("stream", "seq", "frame", "id", late, "s"))
        got = streamed(spark, tmp_path, rows, lambda s: tokens.assemble_stream(s, "stream", "seq", "frame", "ts", "10 minutes"), parts=6)
        assert sorted((r["stream"], r["text"], r["status"]) for r in got if r["stream"][0] != "z") == sorted((s, *v) for s, v in batch.items())


def test_streams_of_files_and_folders(spark, tmp_path):
    from foliant.catalog.streams import run_once, stream_of

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).toPandas().to_parquet(tmp_path / "one.parquet")
    for name, n in (("many", 10), ("one", 4)):
        assert run_once(spark, stream_of(spark, str(tmp_path), name), "test-stream").count() == n
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stream_of(spark, str(tmp_path), "none")


def test_cooldown_state_ends(spark, requests, tmp_path):
    df = with_later_rows(spark, requests)
    got = streamed(spark, tmp_path, df, lambda s: throttle.cooldown_stream(s, ["k"], "ts", "id", 5, "1 hour"), parts=6)
    assert {r["id"]: (r["accepted"], r["retry_after"]) for r in got} == brute_cooldown(df.collect(), 5)
    assert state_left()[0] <= 1  # the last row's own


def test_session_state_ends(spark, requests, tmp_path):
    log = with_later_rows(spark, requests).select("id", "k", "ts", "s", (F.col("id") % 3 == 0).alias("ask"))
    found = F.when(F.col("id") % 3 != 0, F.concat(F.lit("f"), F.col("id")))
    got = streamed(
        spark, tmp_path, log,
        lambda s: session_last_search(s, "k", "ts", "id", F.col("ask"), found, F.lit("based on"), idle="1 day", delay="1 hour"), parts=6,
    )
    last, expected = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["s"], r["id"])):
        if r["ask"]:
            expected[r["id"]] = last.get(r["k"])
        else:
            last[r["k"]] = f"f{r['id']}"
    assert {r["id"]: r["last_search"] for r in got} == expected and state_left()[0] <= 1


@pytest.mark.parametrize("segment", [2, 1, 10_000])
def test_parts_of_streams_equal_batch(spark, tmp_path, segment):
    rows = frames_of(spark).where("stream <> 'd'").withColumn("id", F.col("seq"))
    rows = rows.select("stream", "seq", "frame", "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")).alias("ts"), F.rand(3).alias("s"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # frames come out of order
    batch = tokens.assemble_token_stream(rows, "stream", "seq", "frame", segment).collect()
    got = streamed(spark, tmp_path, rows, lambda s: tokens.assemble_stream_parts(s, "stream", "seq", "frame", "ts", segment), parts=4)
    assert sorted(map(tuple, got)) == sorted((r["stream"], r["part"], r["text"], r["status"]) for r in batch)


def test_lost_parts(spark, tmp_path):
    rows = [("g", 0, "a"), ("g", 1, "b"), ("g", 2, "c"), ("g", 4, "e"), ("g", 1, "b")] + [(f"z{i}", 0, "[DONE]") for i in (1, 2)]
    df = spark.createDataFrame([(s, n, f"data: {p}\n\n", i, float(i)) for i, (s, n, p) in enumerate(rows)], "stream string, seq int, frame string, id int, s double")
    at = F.when(F.col("stream") == "g", 1_700_000_000 + F.col("id")).otherwise(1_700_000_000 + F.col("id") * 100_000)
    got = streamed(spark, tmp_path, df.withColumn("ts", F.timestamp_seconds(at)), lambda s: tokens.assemble_stream_parts(s, "stream", "seq", "frame", "ts", 2), parts=7)
    assert sorted(map(tuple, got)) == [("g", 0, "ab", "open"), ("g", 1, "c", "lost"), ("g", 2, "e", "lost"), ("z1", 0, "", "done"), ("z2", 0, "", "done")]


def test_a_long_stream_keeps_little_state(spark, tmp_path):
    n = 20_000
    payload = F.when(F.col("id") == n - 1, "[DONE]").otherwise(F.concat(F.lit("word "), F.col("id"), F.lit(" " * 40)))
    df = spark.range(n).select(
        F.lit("one").alias("stream"), "id", F.col("id").alias("seq"), F.concat(F.lit("data: "), payload, F.lit("\n\n")).alias("frame"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 1000).alias("ts"), F.col("id").cast("double").alias("s"),
    )
    got = streamed(spark, tmp_path, df, lambda s: tokens.assemble_stream_parts(s, "stream", "seq", "frame", "ts", 500), parts=8)
    assert [r["part"] for r in sorted(got, key=lambda r: r["part"])] == list(range(40))
    assert "".join(r["text"] for r in sorted(got, key=lambda r: r["part"])).split() == [x for i in range(n - 1) for x in ("word", str(i))]
    keys, size = state_left()
    assert keys == 1 and size < 400_000  # the frames are 1.1 MB


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_many_streams_share_few_keys(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(tokens, "BUCKETS", 3)
    big = 2**53 + 1
    rows = [(None if n == 5 else big + n, i, "[DONE]" if i == 2 else f"{n}-{i} ", n % 4 * 10 + i) for n in range(40) for i in range(3) if n % 7 or i < 2]
    rows += [(-1, i, "[DONE]", 10_000 * (i + 1)) for i in range(2)]  # of other buckets or not, they move the watermark on
    df = spark.createDataFrame([(s, i, f"data: {p}\n\n", at, float(at)) for s, i, p, at in rows], "stream bigint, seq int, frame string, id int, s double")
    df = df.withColumn("stream", F.col("stream").cast(kind)).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    wanted = [(None if n == 5 else big + n, f"{n}-0 {n}-1 ", "done" if n % 7 else "lost") for n in range(40)] + [(-1, "", "done")]
    got = streamed(spark, tmp_path, df, lambda s: tokens.assemble_stream(s, "stream", "seq", "frame", "ts"), parts=6)
    assert sorted((str(r["stream"]), r["text"], r["status"]) for r in got) == sorted((str(s), t, e) for s, t, e in wanted)
    assert state_left()[0] <= 3
