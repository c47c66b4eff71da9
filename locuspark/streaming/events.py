"""Streaming forms: windowed counts, duplicates within a watermark, sessions, and per-key runs with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """events with a watermark; a time without zone counts as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """start, by, n over event time; events later than ``late`` behind the newest do not count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _timed(events, ts, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def without_repeats(events: DataFrame, ts: str, key: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark: adjacent duplicates of a sorted stream and those a little apart."""
    return _timed(events, ts, late).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n: clusters of events less than ``gap`` apart."""
    s = _timed(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def runs(events: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """key, value, sta, end, n of runs of equal value, for input whose positions grow along each key.

    A run is told when the next one begins; only the open run of a key is kept as state.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        done = []
        for part in parts:
            part = part.sort_values(pos)
            for p, v in zip(part[pos].tolist(), part[value].tolist()):
                if now is not None and now[0] == v and p == now[2] + 1:
                    now = (v, now[1], p, now[3] + 1)
                else:
                    if now is not None:
                        done.append((k[0], *now))
                    now = (v, p, p, 1)
        if now is not None:
            state.update(now)
        yield pd.DataFrame(done, columns=[key, value, "sta", "end", "n"])

    f = events.schema
    kv = f"{value} {f[value].dataType.simpleString()}, sta {f[pos].dataType.simpleString()}, end {f[pos].dataType.simpleString()}, n long"
    return events.select(key, pos, value).groupBy(key).applyInPandasWithState(step, f"{key} {f[key].dataType.simpleString()}, {kv}", kv, "append", GroupStateTimeout.NoTimeout)
