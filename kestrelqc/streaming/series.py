"""Step and dip checks on a stream of observations.

State is the last two values of each series. A value is judged by its step when it comes, and by its dip when the next one
comes. Observations of a series are taken in the order of their times within a batch; one that is not later than the
last one judged is late and gets no flag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrelqc.cluster import ship
from kestrelqc.flags import DATA_MISSING, FAIL, PASS, WARN

RESULT = "series_id string, ts timestamp, check string, flag string"
STATE = "ts timestamp, before float, before_missing boolean, last float, last_missing boolean, seen int"


def step_of(p: float | None, v: float | None, high: float, max: float) -> str:
    """Flag of one step."""
    if p is None or v is None:
        return DATA_MISSING
    size = abs(np.float32(p) - np.float32(v))
    return WARN if size > np.float32(high) else FAIL if size > np.float32(max) else PASS


def dip_of(p: float | None, v: float | None, x: float | None, high: float, max: float) -> str:
    """Flag of the middle of three values."""
    if p is None or v is None or x is None:
        return DATA_MISSING
    p, v, x = np.float32(p), np.float32(v), np.float32(x)
    if (v > p and v > x) or (v < p and v < x):
        before, after = abs(v - p), abs(x - v)
        total, uneven = after + before, abs(after - before)
        if uneven < total * np.float32(0.35):
            return FAIL if total > np.float32(max) else WARN if total > np.float32(high) else PASS
    return PASS


def check_stream(stream: DataFrame, step: tuple[float, float], dip: tuple[float, float]) -> DataFrame:
    """Flags ``series_id, ts, check, flag`` of a stream ``series_id, ts, value``; ``step`` and ``dip`` are high and max.

    A null value counts as missing. An observation without a time has no place and gets no flag; of equal times in a batch the
    least value counts, and the others are late. A null series is a series. Give the query a checkpoint location, and the
    append mode.
    """
    ship(stream.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).dropna(subset=["ts"]).sort_values(["ts", "value"])
        at, p, p_gone, v, v_gone, seen = state.get if state.exists else (None, 0.0, True, 0.0, True, 0)
        out, v_ts = [], at
        for ts, x in zip(rows["ts"], rows["value"], strict=True):
            if v_ts is not None and ts <= v_ts:
                continue
            x_gone = x is None or bool(pd.isna(x))
            nxt, own, old = (None if gone else value for value, gone in ((x, x_gone), (v, v_gone), (p, p_gone)))
            if seen >= 1:
                out.append((key[0], ts, "step", step_of(own, nxt, *step)))
            if seen >= 2:
                out.append((key[0], v_ts, "dip", dip_of(old, own, nxt, *dip)))
            p, p_gone, v, v_gone, v_ts, seen = v, v_gone, 0.0 if x_gone else float(x), x_gone, ts, min(seen + 1, 2)
        if v_ts is not None:
            state.update((pd.Timestamp(v_ts).to_pydatetime(), float(p), p_gone, float(v), v_gone, seen))
        yield pd.DataFrame(out, columns=["series_id", "ts", "check", "flag"])

    rows = stream.select(F.col("series_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("float").alias("value"))
    return rows.groupBy("series_id").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
