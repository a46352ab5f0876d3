"""Throttling requests by key, in batch and as keyed streams.

cooldown: a request passes if the last *accepted* one is long enough ago. rate_limit: at most N requests in
a period, aligned to the clock or anchored at the first request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from foliant.functions.instants import MICROS, from_micros, micros
from foliant.plans.ordered import BLOCK, Ordered, ordered

PERIODS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _accept(times: np.ndarray, gap: int, last: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(accepted, microseconds to wait, last accepted time) of time-sorted requests of one key."""
    accepted = np.zeros(len(times), dtype=bool)
    since = np.empty(len(times), dtype=np.int64)
    at = 0
    while at < len(times):
        nxt = at if last is None else int(np.searchsorted(times, last + gap))
        nxt = max(nxt, at)
        since[at:nxt] = last if last is not None else 0
        if nxt >= len(times):
            break
        accepted[nxt] = True
        last = int(times[nxt])
        since[nxt] = last
        at = nxt + 1
    return accepted, np.where(accepted, 0, gap - (times - since)), last


def _outcome(pdf: pd.DataFrame, keys: list[str], tie: str, gap: int, last: int | None):
    """Rows in time order with their outcome, and the last accepted time."""
    pdf = pdf.sort_values(["_us", tie], kind="stable")
    accepted, wait, last = _accept(pdf["_us"].to_numpy(np.int64), gap, last)
    retry = pd.array(np.where(accepted, 0, wait // MICROS + 1), dtype="Int64")
    retry[accepted] = pd.NA
    return pdf[[*keys, tie, "_us"]].assign(accepted=accepted, retry_after=retry), last


def _result_schema(df: DataFrame, keys: list[str], tie: str) -> StructType:
    base = StructType([f for f in df.schema.fields if f.name in [*keys, tie, "_us"]])
    ordered_fields = {f.name: f for f in base.fields}
    out = StructType([ordered_fields[n] for n in [*keys, tie, "_us"]])
    return out.add("accepted", "boolean").add("retry_after", "long")


def _with_time(df: DataFrame, requests: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("ts", from_micros(F.col("_us"), requests.schema[ts].dataType)).drop("_us")


def _new_group(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True on rows whose key differs from the row before (the first row is left to the caller)."""
    n = batch.num_rows
    fresh = np.zeros(n, dtype=bool)
    for key in keys:
        column = batch.column(key)
        here, before = column.slice(1), column.slice(0, n - 1)
        same = pc.fill_null(pc.equal(here, before), False).to_numpy(zero_copy_only=False)
        nulls = pc.and_(here.is_null(), before.is_null()).to_numpy(zero_copy_only=False)
        fresh[1:] |= ~(same | nulls)
    return fresh


def _accept_sorted(keys: list[str], out: list[str], gap: int, entry: str | None = None):
    """Walk rows sorted by key and time, batch by batch; only the last accepted time is kept between batches.

    ``entry`` may name a column with the last accepted time before a group begins.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column("_us").to_numpy()
            fresh = _new_group(batch, keys)
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            fresh[0] = first != current
            accepted, wait = np.zeros(len(times), dtype=bool), np.zeros(len(times), dtype=np.int64)
            starts = np.unique(np.append(0, np.flatnonzero(fresh)))
            for at, end in zip(starts, [*starts[1:], len(times)]):
                if fresh[at]:
                    last = batch.column(entry)[int(at)].as_py() if entry else None
                accepted[at:end], wait[at:end], last = _accept(times[at:end], gap, last)
            current = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
            retry = pa.array(wait // MICROS + 1, mask=accepted)
            columns = [*[batch.column(c) for c in out], pa.array(accepted), retry]
            yield pa.RecordBatch.from_arrays(columns, names=[*out, "accepted", "retry_after"])

    return walk


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cooldown(
    requests: DataFrame, keys: list[str], ts: str, tie: str, seconds: float, **kw
) -> DataFrame:
    """(keys, tie, ts, accepted, retry_after); a rejected request does not restart the clock.

    One shuffle by key and a sort inside the tasks; rows stream through them, no key is held in memory.
    """
    gap = int(seconds * MICROS)
    rows = requests.select(*keys, tie, micros(requests, ts).alias("_us"))
    schema = _result_schema(rows, keys, tie)
    o = ordered(rows, keys, ["_us", tie], **kw)
    if o.split:
        return _with_time(_cooldown_blocks(o, tie, gap, schema), requests, ts)
    in_order = rows.repartition(_tasks(rows), *keys).sortWithinPartitions(*keys, "_us", tie)
    out = in_order.mapInArrow(_accept_sorted(keys, [*keys, tie, "_us"], gap), schema)
    return _with_time(out, requests, ts)


def _cooldown_blocks(o: Ordered, tie: str, gap: int, schema: StructType) -> DataFrame:
    """The same for keys cut into blocks of bounded size.

    What a block needs from its past is one number, the last accepted time, and it only decides which
    of the block's first rows is accepted first. So each block says where every such beginning would end
    (one entry for each different end), these tables are walked block by block, and then all blocks
    run at once from their true beginning. Only keys that lie in several blocks need the first two steps.
    """
    keys, parts = o.keys, [*o.keys, BLOCK]
    key_fields = [f for f in schema.fields if f.name in keys]
    at_block = StructType([*key_fields, StructField(BLOCK, IntegerType())])
    times_type = ArrayType(LongType())
    ends_schema = StructType([*at_block.fields, StructField("first", times_type), StructField("end", times_type)])
    entry_schema = StructType([*at_block.fields, StructField("entry", LongType())])

    def ends_of(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy(np.int64))
        n = len(times)
        nxt = np.searchsorted(times, times + gap)
        jump = np.where(nxt < n, nxt, np.arange(n))
        while True:
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        last = min(n - 1, int(np.searchsorted(times, times[0] + gap)))
        first, end = times[: last + 1], times[jump[: last + 1]]
        keep = np.append(end[1:] != end[:-1], True)
        row = pdf.iloc[[0]][parts].copy()
        row["first"], row["end"] = [first[keep].tolist()], [end[keep].tolist()]
        return row

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        last, entries = None, []
        for first, end in zip(pdf["first"], pdf["end"]):
            entries.append(last)
            i = 0 if last is None else int(np.searchsorted(first, last + gap))
            last = int(end[i]) if i < len(first) else last
        return pdf[parts].assign(entry=pd.array(entries, dtype="Int64"))

    marks = o.spanning(o.df.select(*parts).distinct()).withColumn("_marked", F.lit(True))
    carrying = o.attach(o.df, marks).where("_marked").drop("_marked")
    ends = carrying.groupBy(*parts).applyInPandas(ends_of, ends_schema)
    entries = ends.groupBy(*keys).applyInPandas(walk, entry_schema)
    begun = o.attach(o.df, entries)
    in_order = begun.repartition(_tasks(begun), *parts).sortWithinPartitions(*parts, "_us", tie)
    return in_order.mapInArrow(_accept_sorted(parts, [*keys, tie, "_us"], gap, "entry"), schema)


def rate_limit(
    requests: DataFrame, keys: list[str], ts: str, tie: str, n: int, period: str = "minute"
) -> DataFrame:
    """Accepted requests under a clock-aligned limit. Each task keeps the first ``n`` before the shuffle."""
    cell = F.floor(micros(requests, ts) / (PERIODS[period] * MICROS))
    w = Window.partitionBy(*keys, "_cell").orderBy(ts, tie)
    numbered = requests.withColumn("_cell", cell).withColumn("_no", F.row_number().over(w))
    return numbered.where(F.col("_no") <= n).drop("_cell", "_no")


def rate_limit_anchored(
    requests: DataFrame, keys: list[str], ts: str, tie: str, n: int, period: str = "minute", **kw
) -> DataFrame:
    """The same with periods that start at the first request after the previous period; rejected ones count."""
    begun = cooldown(requests, keys, ts, tie, PERIODS[period], **kw)
    marked = begun.withColumn("_start", F.when(F.col("accepted"), F.col("ts")))
    placed = ordered(marked, keys, ["ts", tie], sized_by=requests, **kw).carry("_start", "period_start").rows()
    w = Window.partitionBy(*keys, "period_start").orderBy("ts", tie)
    first = placed.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= n)
    return first.select(*keys, tie, "ts", "period_start")


def cooldown_stream(
    requests: DataFrame, keys: list[str], ts: str, tie: str, seconds: float, delay: str = "1 day"
) -> DataFrame:
    """Keyed state: the last accepted time, until the watermark is past its cooldown.

    A row older than the state counts as inside the cooldown; one that is later than ``delay`` is dropped. A key whose
    state is gone starts anew, as it would with it, since no row that still comes lies inside that cooldown.
    """
    gap = int(seconds * MICROS)
    seen = F.col(ts).cast("timestamp").alias("_seen")
    rows = requests.select(*keys, tie, seen, micros(requests, ts).alias("_us")).withWatermark("_seen", delay)
    schema = _result_schema(rows.drop("_seen"), keys, tie)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).drop(columns="_seen")
        out, last = _outcome(pdf, keys, tie, gap, state.get[0] if state.exists else None)
        until = (last + gap) // 1000 + 1
        if until > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield out

    out = rows.groupBy(*keys).applyInPandasWithState(
        step, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return _with_time(out, requests, ts)


def rate_limit_stream(
    requests: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    n: int,
    period: str = "minute",
    anchored: bool = False,
    delay: str = "1 day",
) -> DataFrame:
    """Accepted requests; the state of a key is its current period and count, dropped by watermark.

    Rows of a micro-batch are taken in time order; a row that comes after a later period has begun counts
    to that period.
    """
    length = PERIODS[period] * MICROS
    seen = F.col(ts).cast("timestamp").alias("_seen")
    rows = requests.select(*keys, tie, seen, micros(requests, ts).alias("_us")).withWatermark("_seen", delay)
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([fields[c] for c in [*keys, tie, "_us"]])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["_us", tie], kind="stable")
        start, count = state.get if state.exists else (None, 0)
        kept = np.zeros(len(pdf), dtype=bool)
        for i, us in enumerate(pdf["_us"].to_numpy(np.int64)):
            if start is None or us >= start + length:
                start, count = (int(us) if anchored else int(us // length * length)), 0
            count += 1
            kept[i] = count <= n
        state.update((start, count))
        ends = (start + length) // 1000
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield pdf.loc[kept, [*keys, tie, "_us"]]

    out = rows.groupBy(*keys).applyInPandasWithState(
        step, schema, "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return _with_time(out, requests, ts)
