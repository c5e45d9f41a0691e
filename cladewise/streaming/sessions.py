"""Streams of windowed events: what runs of windows are to pairs, sessions are to users. An extension; batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Runs of a user's events without a longer gap: user_id, start, end, n, total. late: watermark, for streams."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding_counts(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    """Events by type in sliding windows of time."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_names(events: DataFrame, *keys: str, late: str) -> DataFrame:
    """A stream without repeats of keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
