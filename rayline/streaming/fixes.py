"""Fixes as a stream: pairs of consecutive fixes and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = "entity string, ts timestamp, lat double, lon double, prev_lat double, prev_lon double"


def paired_stream(fixes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Pairs of consecutive fixes of (entity, ts, lat, lon); the state is one fix per entity.

    Fixes of a batch are paired in order of time.  A fix older than the one last seen is dropped.  With
    `idle_ms`, an entity that stays silent for so long is forgotten and its next fix starts anew; such a query always
    has another batch to run, so it suits continuous triggers only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        last = state.get if state.exists else None
        out = []
        for ts, lat, lon in zip(rows["ts"], rows["lat"], rows["lon"], strict=True):
            micros = ts.value // 1000
            if last is not None and micros < last[0]:
                continue
            if last is not None:
                out.append((key[0], ts, lat, lon, last[1], last[2]))
            last = (micros, lat, lon)
        if last is not None:
            state.update(last)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["entity", "ts", "lat", "lon", "prev_lat", "prev_lon"])

    return fixes.groupBy("entity").applyInPandasWithState(step, PAIR, "micros long, lat double, lon double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def outcome_windows(results: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Outcomes counted by tumbling windows of event time; rows later than `late` are left out."""
    return results.withWatermark("ts", late).groupBy(F.window("ts", width), "outcome").agg(F.count("*").alias("cases"))
