import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foliant.llm.warc import page_records, read_warc, salvage, write_warc
from foliant.plans.sizing import scratch_path


def record(body, kind="response", length=None, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(body) if length is None else length}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def bodies(data):
    return [x.block for x in salvage(data) if x.headers is not None]


def gaps(data):
    return [(x.start, x.end) for x in salvage(data) if x.headers is None]


PLAIN = [record(b"one"), record(b"two WARC/1.0 inside\nWARC/1.0\r\nnot a record"), record(b"")]


def test_sound_archives_have_no_gaps():
    plain = b"".join(PLAIN)
    members = b"".join(gzip.compress(r) for r in PLAIN)
    for data in (plain, members, gzip.compress(plain), members + plain, b""):
        assert not gaps(data)
    assert bodies(plain) == bodies(members) == bodies(gzip.compress(plain)) and len(bodies(plain)) == 3


@pytest.mark.parametrize("gz", [False, True])
def test_later_records_come_back_and_the_bytes_between_are_reported(gz):
    parts = [gzip.compress(r) if gz else r for r in (record(b"first" * 50), record(b"second" * 50), record(b"third"))]
    broken = bytearray(parts[1])
    if gz:
        broken[30] ^= 0xFF
    else:
        broken[: len(b"WARC/1.0")] = b"JUNKJUNK"
    data = parts[0] + bytes(broken) + parts[2]
    assert bodies(data) == [b"first" * 50, b"third"]
    assert gaps(data) == [(len(parts[0]), len(parts[0]) + len(parts[1]))]


def test_wrong_length_cut_off_and_wrong_digest():
    good = record(b"good")
    for bad in (record(b"abc", length=2), record(b"abc", length=900), record(b"abc", length="x"), record(b"abc", extra="WARC-Block-Digest: sha1:AAAA\r\n")):
        assert bodies(good + bad + good) == [b"good", b"good"]
    cut = gzip.compress(record(b"tail"))[:-5]
    assert bodies(good + cut) == [b"good"] and gaps(good + cut) == [(len(good), len(good) + len(cut))]
    assert gaps(b"no archive") == [(0, 10)]


def digested(body):
    return record(body, extra=f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n")


NOISE = [random.Random(i).randbytes(30_000).hex().encode() for i in range(5)]


def told(data):
    return [(NOISE.index(x.block) if x.block in NOISE else None, x.reason != "") if x.headers is not None else "gap" for x in salvage(data)]


def test_a_bad_record_inside_a_sound_member():
    inner = [digested(b) for b in NOISE]
    inner[2] = inner[2].replace(b"Content-Length", b"Content-Langth")
    member = gzip.compress(b"".join(inner))
    data = gzip.compress(digested(NOISE[0])) + member + gzip.compress(digested(NOISE[4]))
    assert told(data) == [(0, False), (0, False), (1, False), "gap", (3, False), (4, False), (4, False)]
    (gap,) = [x for x in salvage(data) if x.headers is None]
    begin, inner_begin = len(gzip.compress(digested(NOISE[0]))), len(inner[0] + inner[1])
    assert (gap.start, gap.end) == (begin, begin + len(member))
    assert (gap.inner_start, gap.inner_end) == (inner_begin, inner_begin + len(inner[2]))


@pytest.mark.parametrize("made", [record, digested])
def test_a_member_of_several_records_with_a_bad_crc_or_a_cut_off_end(made):
    whole, after = gzip.compress(b"".join(map(made, NOISE))), gzip.compress(made(NOISE[0]))
    unsure, cut = made is record, len(whole) * 7 // 10
    crc = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    kept = [(i, unsure) for i in range(4 if unsure else 5)] + ["gap"]  # nothing vouches for the last one without digest
    assert told(crc + after) == [*kept, (0, False)]
    for data in (whole[:cut], whole[:cut] + after):
        assert told(data) == [(i, unsure) for i in range(3)] + ["gap"] + [(0, False)] * (data[-9:] == after[-9:])
    damaged = bytearray(whole)
    damaged[cut : cut + 3] = b"!?!"  # a wrong byte in the middle
    assert told(bytes(damaged) + after)[:3] == [(i, unsure) for i in range(3)]
    assert told(bytes(damaged) + after)[-1] == (0, False)
    # two damaged members after each other
    assert told(whole[:cut] + crc) == [(i, unsure) for i in range(3)] + ["gap", *kept]


def test_unverified_records_are_a_kind_of_their_own(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"one") + digested(b"two") + record(NOISE[0]))[:-30])
    rows = read_warc(spark, str(tmp_path)).collect()
    assert [(r.kind, r.payload and bytes(r.payload)) for r in rows] == [("unverified", b"one"), ("record", b"two"), ("gap", None)]
    assert all(r.reason == (None if r.kind == "record" else r.reason) and r.inner_end > r.inner_start for r in rows)


def test_any_damage_leaves_every_byte_in_a_record_or_a_gap():
    rng = random.Random(4)
    sound = b"".join(gzip.compress(r) if i % 2 else r for i, r in enumerate(PLAIN * 3))
    for _ in range(300):
        data = bytearray(sound)
        for _ in range(rng.randint(1, 4)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        at = 0
        for x in salvage(bytes(data)):
            assert x.start in (at, at) and x.end > x.start
            at = x.end
        assert at == len(data)


def test_pages_go_through_archives(spark):
    long = "ü" * 60
    rows = [(1, "http://a", "short"), (2, "http://b", "short"), (5, None, long), (3, "http://c\r\nX: y", long), (3, "http://d", long), (None, "u", long), (9, "e", None), (8, "", ""), (4, "x", "WARC/1.1\r\n" * 30)]
    path = scratch_path(spark, "test-warc")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    write_warc(pages, path)
    read = read_warc(spark, path)
    assert read.where("kind = 'gap'").count() == 0
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in page_records(read).collect()}
    assert got == {(1, "response", None, 5), (2, "response", None, 5), (5, "revisit", 3, 120), (3, "response", None, 120), (None, "revisit", 3, 120), (9, "response", None, 0), (8, "response", None, 0), (4, "response", None, 300)}
    assert page_records(read).count() == len(rows)
    digests = {r.payload_digest for r in page_records(read).where("payload_bytes = 120").collect()}
    assert len(digests) == 1


def test_no_pages(spark):
    path = scratch_path(spark, "test-warc")
    write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert page_records(read_warc(spark, path)).count() == 0
