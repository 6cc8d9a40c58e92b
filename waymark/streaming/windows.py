"""Event windows over a stream (an extension; the batch engine does not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; rows later than the watermark are left out."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = watched.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: runs of events without a pause of ``gap``."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = watched.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")
