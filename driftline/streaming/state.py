"""Streams of requests: decayed heat as keyed state, and windows of counts by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def heat_stream(hits: DataFrame, half_life: float) -> DataFrame:
    """(item_id, heat, clock) updates from a stream (item_id, seq): each key keeps its heat and the last request."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heat, clock = state.get if state.exists else (0.0, 0)
        seqs = sorted(s for frame in frames for s in frame.seq)
        last = max(clock, seqs[-1])
        heat = heat * 2.0 ** (-(last - clock) / half_life) + sum(2.0 ** (-(last - s) / half_life) for s in seqs)
        state.update((heat, int(last)))
        yield pd.DataFrame({"item_id": [key[0]], "heat": [heat], "clock": [last]})

    return hits.groupBy("item_id").applyInPandasWithState(update, "item_id bigint, heat double, clock bigint", "heat double, clock bigint", "update", GroupStateTimeout.NoTimeout)


def lease_stream(events: DataFrame, lease_seconds: float) -> DataFrame:
    """(item_id, fence, outcome) from a stream (item_id, t, kind, fence): claims take a free or expired lease, and
    publications count only under the lease that holds then; time is that of the events."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, expires, done = state.get if state.exists else (-1, 0.0, False)
        out = []
        rows = sorted((r for frame in frames for r in frame[["t", "fence", "kind"]].itertuples(index=False)), key=tuple)
        for t, fence, kind in rows:
            if kind == "claim":
                ok = not done and (held < 0 or expires < t)
                held, expires = (int(fence), t + lease_seconds) if ok else (held, expires)
                out.append((key[0], fence, "claimed" if ok else "refused"))
            else:
                ok = not done and held == fence and expires >= t
                done, held = done or ok, -1 if ok else held
                out.append((key[0], fence, "published" if ok else "stale"))
        state.update((held, float(expires), done))
        yield pd.DataFrame(out, columns=["item_id", "fence", "outcome"])

    return events.groupBy("item_id").applyInPandasWithState(update, "item_id bigint, fence bigint, outcome string", "held bigint, expires double, done boolean", "update", GroupStateTimeout.NoTimeout)


def request_windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, event_type, n): requests by window of event time, late ones dropped after the watermark."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
