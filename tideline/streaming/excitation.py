"""Streaming forms: windowed counts, and the excitation state of a process kept between batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, leg int, t double, r_0 double, r_1 double"
STATE = "t double, r0 double, r1 double, n0 double, n1 double"


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "60 seconds", late: str = "120 seconds") -> DataFrame:
    """Events a tumbling window and leg; the watermark is the stream's finality cutoff."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "leg").agg(F.count("*").alias("n"))


def final_duplicates(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "120 seconds") -> DataFrame:
    """The first row of each key within the watermark: the idempotent manifest of a stream."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def advance(state: tuple[float, float, float, float, float] | None, events: list[tuple[float, int]], beta: float):
    """(leg, t, r0, r1) of events in order of time, and the state after them; ties share one state.

    state: last time, excitation just before it, and the events at it, by leg.
    """
    t0, r0, r1, n0, n1 = state or (-math.inf, 0.0, 0.0, 0.0, 0.0)
    out = []
    for t, leg in events:
        if t > t0:
            fade = math.exp(-beta * (t - t0)) if t0 > -math.inf else 0.0
            r0, r1, n0, n1, t0 = fade * (r0 + n0), fade * (r1 + n1), 0.0, 0.0, t
        out.append((leg, t, r0, r1))
        n0, n1 = n0 + (leg == 0), n1 + (leg == 1)
    return out, (t0, r0, r1, n0, n1)


def excitation_stream(stream: DataFrame, beta: float) -> DataFrame:
    """key, leg, t, r_0, r_1 of a stream (key, leg, t): one small state a key, whatever its history.

    Events of a key must not be older than its last event of an earlier batch; older ones are left out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["t", "leg"], kind="stable")
        if held is not None:
            pdf = pdf[pdf["t"] >= held[0]]
        out, after = advance(held, list(zip(pdf["t"].tolist(), pdf["leg"].tolist(), strict=True)), beta)
        if out:
            state.update(after)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "leg", "t", "r_0", "r_1"])

    return stream.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
