"""Streaming form of the retrieval context: session state holds the latest successful search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.instants import micros
from foliant.operators.context import wants_context


def session_last_search(
    log: DataFrame,
    session: str,
    ts: str,
    tie: str,
    is_prompt: Column,
    found: Column,
    prompt: Column,
    idle: str = "30 days",
    delay: str = "1 day",
) -> DataFrame:
    """(session, tie, last_search) for each prompt; searches without result (NULL) do not overwrite.

    ``found`` is text; a structured result is passed as JSON. A session's search is forgotten when the watermark, ``delay``
    behind the latest row, is ``idle`` past the session's own latest row; rows later than ``delay`` are dropped.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = log.select(
        session, tie, F.col(ts).cast("timestamp").alias("_seen"), micros(log, ts).alias("_us"), is_prompt.alias("_ask"),
        found.cast("string").alias("_found"), wants_context(prompt).alias("_wants"),
    ).withWatermark("_seen", delay)
    rows = rows.where(F.col("_ask") | F.col("_found").isNotNull())  # other rows say nothing
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["_us", tie], kind="stable")
        last, latest = state.get if state.exists else (None, 0)
        known = pd.concat([pd.Series([last], dtype="object"), pdf["_found"].astype("object")]).ffill().iloc[1:]
        out = pdf[[session, tie]].assign(last_search=known.to_numpy())
        out.loc[~pdf["_wants"].fillna(False).astype(bool).to_numpy(), "last_search"] = None
        if len(known) and pd.notna(known.iloc[-1]):
            latest = max(latest, int(pdf["_us"].iloc[-1]) // 1000)
            if latest + idle_ms > state.getCurrentWatermarkMs():
                state.update((known.iloc[-1], latest))
                state.setTimeoutTimestamp(latest + idle_ms)
            elif state.exists:
                state.remove()
        yield out[pdf["_ask"].astype(bool).to_numpy()]

    return rows.groupBy(session).applyInPandasWithState(
        step,
        f"{session} {kinds[session]}, {tie} {kinds[tie]}, last_search string",
        "last string, latest bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
