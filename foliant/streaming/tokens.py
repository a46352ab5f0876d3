"""Framing token streams for delivery and putting them together again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.text import sse_escape, sse_unescape

# The wire format.
DATA, END = "data: ", "\n\n"
DONE, ERROR = "[DONE]", "[ERROR]"

SEGMENT = 10_000
CLOSED = -1  # part of a stream that has been given out
BUCKETS = 4096  # keys that the streams share


def frame_token_stream(tokens: DataFrame, chunk: str, error: str | None = None) -> DataFrame:
    """Add ``frame``: the chunk as a data frame, or the terminal frame on the row that ends the stream.

    A NULL chunk ends the stream, with an error if the ``error`` column has a text. No shuffle.
    """
    closing: Column = F.lit(DONE)
    if error:
        failed = F.concat(F.lit(ERROR + " "), F.col(error))
        closing = F.when(F.col(error).isNotNull(), failed).otherwise(closing)
    body = F.coalesce(sse_escape(F.col(chunk)), closing)
    return tokens.withColumn("frame", F.concat(F.lit(DATA), body, F.lit(END)))


def frame_payload(frame: Column) -> Column:
    framed = F.startswith(frame, F.lit(DATA)) & F.endswith(frame, F.lit(END))
    length = F.length(frame) - len(DATA) - len(END)
    return F.when(framed, F.substring(frame, F.lit(len(DATA) + 1), length)).otherwise(frame)


def _is_end(payload: Column) -> Column:
    return (payload == DONE) | F.startswith(payload, F.lit(ERROR))


def assemble_token_stream(
    frames: DataFrame, stream: str, seq: str, frame: str, segment: int = SEGMENT
) -> DataFrame:
    """(stream, part, text, status): chunks in order up to the first terminal frame.

    A long stream is put together in parts of ``segment`` frames, so no task holds a whole one; streams
    below that come out as one row. An error frame adds its text on a new line. Frames are numbered from 0; a stream
    without terminal frame, or with a frame missing before it, is lost. Later frames count for nothing.
    """
    rows = frames.select(
        stream,
        F.col(seq).alias("_seq"),
        F.floor(F.col(seq) / segment).cast("bigint").alias("part"),
        frame_payload(F.col(frame)).alias("_p"),
    )
    parts = rows.groupBy(stream, "part").agg(
        F.sort_array(F.collect_list(F.struct("_seq", "_p"))).alias("_rows")
    )
    closing = F.transform(F.filter("_rows", lambda r: _is_end(r["_p"])), lambda r: r["_seq"])
    parts = parts.withColumn("_end", F.array_min(closing))
    # A part is whole if all its numbers up to its end are there.
    numbers = F.array_distinct(F.transform("_rows", lambda r: r["_seq"]))
    up_to_end = F.filter(numbers, lambda s: F.col("_end").isNull() | (s <= F.col("_end")))
    needed = F.when(F.col("_end").isNull(), segment).otherwise(F.col("_end") - F.col("part") * segment + 1)
    parts = parts.withColumn("_whole", F.size(up_to_end) == needed)
    # One small row for each part carries the end of its stream, so both sides of the join are even.
    of_stream = Window.partitionBy(stream)
    known = parts.select(stream, "part", "_whole", F.min("_end").over(of_stream).alias("_stop"))
    stop = F.col("_stop")
    whole = F.count_if(F.col("_whole") & (F.col("part") <= F.floor(stop / segment))).over(of_stream)
    known = known.withColumn("_gap", whole != F.floor(stop / segment) + 1).drop("_whole")
    joined = parts.drop("_end", "_whole").join(known, [stream, "part"])
    live = F.filter("_rows", lambda r: stop.isNull() | (r["_seq"] <= stop))

    def text(r: Column) -> Column:
        failed = F.concat(F.lit("\n"), r["_p"])
        plain = sse_unescape(r["_p"])
        return F.when(r["_p"] == DONE, "").when(F.startswith(r["_p"], F.lit(ERROR)), failed).otherwise(plain)

    last = F.element_at("_rows", -1)["_p"]
    here = F.floor(stop / segment) == F.col("part")
    return (
        joined.where(stop.isNull() | (F.col("part") <= F.floor(stop / segment)))
        .withColumn("_rows", live)
        .select(
            stream,
            "part",
            F.array_join(F.transform("_rows", text), "").alias("text"),
            F.when(stop.isNull() | F.col("_gap"), "lost")
            .when(~here, "open")
            .when(F.startswith(last, F.lit(ERROR)), "error")
            .otherwise("done")
            .alias("status"),
        )
    )


def _frames_by_bucket(
    frames: DataFrame, stream: str, seq: str, frame: str, ts: str, timeout: str, advance, lost, fields: str, again: bool
) -> DataFrame:
    """Frames to what ``advance`` and ``lost`` give out, with the state of many streams kept together.

    Handing rows and state to Python costs some milliseconds for each key, so streams share BUCKETS keys; each has its own part
    (CLOSED when it is closed), frames and deadline there. ``again``: frames that come after the end put off its deadline.
    """
    delay_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    kind = frames.schema[stream].dataType.simpleString()
    rows = frames.select(
        F.pmod(F.xxhash64(stream), F.lit(BUCKETS)).alias("_bucket"), F.col(stream).cast("string").alias("_stream"),
        F.col(seq).cast("bigint").alias("_seq"), frame_payload(F.col(frame)).alias("_p"), F.col(ts).alias("_ts"),
    ).withWatermark("_ts", timeout)
    names = [f.split()[0] for f in fields.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[str | None, list] = {}
        if state.exists:
            streams, parts, deadlines, sizes, seqs, payloads = state.get
            pairs = iter(zip(seqs, payloads))
            for s, part, deadline, n in zip(streams, parts, deadlines, sizes):
                kept[s] = [part, deadline, dict(next(pairs) for _ in range(n))]
        latest: dict[str | None, int] = {}
        if not state.hasTimedOut:
            for pdf in batches:
                sent = pdf["_ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
                for s, q, p, ms in zip(pdf["_stream"].tolist(), pdf["_seq"].tolist(), pdf["_p"].tolist(), sent):
                    latest[s] = max(latest.get(s, 0), ms)
                    part, _, held = kept.setdefault(s, [0, 0, {}])
                    if part != CLOSED:
                        held[int(q)] = p
        now, out = state.getCurrentWatermarkMs(), []
        for s, ms in latest.items():
            part, deadline, held = kept[s]
            if part == CLOSED and not again:
                continue
            if part != CLOSED:
                part, held, found = advance(part, held)
                out += [(s, *row) for row in found]
            kept[s] = [part, max(ms, now) + delay_ms, held]
        for s in [s for s, (_, deadline, _) in kept.items() if s not in latest and deadline < now]:
            part, _, held = kept.pop(s)
            if part != CLOSED:
                out += [(s, *row) for row in lost(part, held)]
        if kept:
            told = list(zip(*kept.values()))
            pairs = [pair for held in told[2] for pair in held.items()]
            state.update((list(kept), list(told[0]), list(told[1]), [len(h) for h in told[2]], [q for q, _ in pairs], [p for _, p in pairs]))
            state.setTimeoutTimestamp(max(min(told[1]), now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["_stream", *names])

    told = rows.groupBy("_bucket").applyInPandasWithState(
        step,
        f"_stream string, {fields}",
        "streams array<string>, parts array<bigint>, deadlines array<bigint>, sizes array<bigint>, seqs array<bigint>, payloads array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return told.select(F.col("_stream").cast(kind).alias(stream), *names)


def assemble_stream(
    frames: DataFrame, stream: str, seq: str, frame: str, ts: str, timeout: str = "10 minutes"
) -> DataFrame:
    """Streaming form: emits (stream, text, status) once all frames up to the terminal one are there.

    A stream without news until the watermark passes its timeout is given out as lost. Frames after the terminal one
    are dropped; that a stream is closed is remembered until the timeout.
    """

    def joined(chunks: dict[int, str]) -> str:
        """Text up to the first terminal frame, of which only an error's text is shown."""
        end = min((s for s, p in chunks.items() if p == DONE or p.startswith(ERROR)), default=None)
        text = "".join(p for s, p in sorted(chunks.items()) if end is None or s < end).replace("\\n", "\n")
        return text if end is None or chunks[end] == DONE else text + "\n" + chunks[end]

    def advance(part: int, chunks: dict[int, str]) -> tuple[int, dict[int, str], list[tuple]]:
        ends = [s for s, p in chunks.items() if p == DONE or p.startswith(ERROR)]
        if not ends or not all(s in chunks for s in range(min(ends))):
            return part, chunks, []
        return CLOSED, {}, [(joined(chunks), "done" if chunks[min(ends)] == DONE else "error")]

    return _frames_by_bucket(
        frames, stream, seq, frame, ts, timeout, advance, lambda part, chunks: [(joined(chunks), "lost")], "text string, status string", False
    )


def assemble_stream_parts(
    frames: DataFrame, stream: str, seq: str, frame: str, ts: str, segment: int = SEGMENT, timeout: str = "10 minutes"
) -> DataFrame:
    """Long streams part by part: (stream, part, text, status), the parts of ``segment`` frames like those of the batch form.

    A part is given out as soon as all its frames and those before it are there, with status open, or done or error if the
    stream ends in it. State keeps only what was not given out yet: at most one part, and frames that came before
    their turn. A stream without news until the watermark passes its timeout gives out the rest as lost; what it gave out before
    stays open. Frames that come again, or after the end, are dropped.
    """

    def text(payloads: list[str]) -> str:
        return "".join("" if p == DONE else "\n" + p if p.startswith(ERROR) else p.replace("\\n", "\n") for p in payloads)

    def advance(part: int, held: dict[int, str]) -> tuple[int, dict[int, str], list[tuple]]:
        out: list[tuple[int, str, str]] = []
        while True:
            here: list[str] = []
            for s in range(part * segment, (part + 1) * segment):
                if s not in held:
                    break
                here.append(held[s])
                if here[-1] == DONE or here[-1].startswith(ERROR):
                    break
            last = here[-1] if here else ""
            if last == DONE or last.startswith(ERROR):
                out.append((part, text(here), "done" if last == DONE else "error"))
                return CLOSED, {}, out
            if len(here) < segment:
                return part, {s: p for s, p in held.items() if s >= part * segment}, out
            out.append((part, text(here), "open"))
            part += 1

    def lost(part: int, held: dict[int, str]) -> list[tuple]:
        return [(p, text([held[s] for s in sorted(held) if s // segment == p]), "lost") for p in sorted({s // segment for s in held})]

    return _frames_by_bucket(
        frames, stream, seq, frame, ts, timeout, advance, lost, "part bigint, text string, status string", True
    )
