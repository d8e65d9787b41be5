"""Windows, sessions, late data, duplicates and keyed state over streams of events (ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def tumbling(events: DataFrame, width: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of event time; with a slide they overlap. A watermark bounds a stream's state."""
    if watermark is not None:
        events = events.withWatermark("ts", watermark)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events of which none is the gap or more after the last."""
    if watermark is not None:
        events = events.withWatermark("ts", watermark)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, keys: list[str], watermark: str | None = None) -> DataFrame:
    """The first event of each key; in a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark or "1 hour").dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for b in batches:
        n, total = n + len(b), total + float(b["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) of a stream: each micro-batch gives the new totals of the users it has."""
    return events.groupBy("user_id").applyInPandasWithState(_count, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")
