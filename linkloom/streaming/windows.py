"""Counts in windows and sessions of event time, on streams and on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str, late: str, length: str, slide: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in tumbling or sliding windows of event time, with a bound on lateness. Works on streams and on tables."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(w.alias("window"), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of one key that end after a gap."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("session"), by).agg(F.count("*").alias("n"))
