"""Leases in a stream: a stateful operator keyed by (stream, consumer).

Input rows (stream, consumer, t_ms, action, offset, timeout_ms), action `deliver` or `ack`. State holds each
live lease's deadline and attempts. Time is what the rows say and never runs back; a lease whose deadline is at or
before it expires when the next row of the key is seen, as in the batch operators, or without one when the stream's
watermark passes the deadline: each key has a timer at its earliest deadline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stream string, consumer string, offset long, event string, attempt int, t_ms long"
STATE = "now_ms long, offsets array<long>, deadlines array<long>, tried array<long>, attempts array<int>"


def expire(now: int, live: dict[int, int], tried: dict[int, int]) -> list[tuple[int, str, int]]:
    """Ends the leases whose deadline is at or before now; returns their events."""
    over = sorted(o for o, deadline in live.items() if deadline <= now)
    for o in over:
        del live[o]
    return [(o, "expired", tried[o]) for o in over]


def step(now: int, live: dict[int, int], tried: dict[int, int], row) -> tuple[int, list[tuple[int, str, int]]]:
    """Applies one row; returns the clock and the events (offset, event, attempt)."""
    now = max(now, row.t_ms)
    out = expire(now, live, tried)
    if row.action == "ack":
        if row.offset in live:
            del live[row.offset]
            out.append((row.offset, "acknowledged", tried.pop(row.offset)))
        else:
            out.append((row.offset, "stale", tried.get(row.offset, 0)))
    elif row.offset in live:
        out.append((row.offset, "held", tried[row.offset]))
    else:
        tried[row.offset] = tried.get(row.offset, 0) + 1
        live[row.offset] = now + row.timeout_ms
        out.append((row.offset, "delivered", tried[row.offset]))
    return now, out


def track(events: DataFrame, late_ms: int = 0) -> DataFrame:
    """The lease events of a streaming frame; rows may come late_ms after later ones before the watermark, and so a timer, passes them."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, live, tried = 0, {}, {}
        if state.exists:
            now, offsets, deadlines, t, n = state.get
            live, tried = dict(zip(offsets, deadlines)), dict(zip(t, n))
        rows: list[tuple] = []
        if state.hasTimedOut:
            now = max(now, state.getCurrentWatermarkMs() - 1)
            rows = [(*key, int(o), e, int(a), int(now)) for o, e, a in expire(now, live, tried)]
        else:
            for row in pd.concat(list(frames)).sort_values(["t_ms", "offset"], kind="stable").itertuples():
                now, out = step(now, live, tried, row)
                rows += [(*key, int(o), e, int(a), int(now)) for o, e, a in out]
        state.update((int(now), [int(x) for x in live], [int(x) for x in live.values()], [int(x) for x in tried], [int(x) for x in tried.values()]))
        if live:  # a timer can't be set in the past; one that is due goes off with the next batch
            state.setTimeoutTimestamp(max(int(min(live.values())) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["stream", "consumer", "offset", "event", "attempt", "t_ms"])

    # event time is one later than t_ms, since a first watermark of 0 would make rows of time 0 late
    timed = events.withColumn("_time", F.timestamp_millis(F.col("t_ms") + 1)).withWatermark("_time", f"{late_ms} milliseconds")
    return timed.groupBy("stream", "consumer").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
