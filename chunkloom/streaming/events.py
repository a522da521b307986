"""Windows over events, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, watermark: str | None) -> DataFrame:
    """The events with a watermark; event times without a zone are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events


def tumbling(events: DataFrame, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window; on a stream, rows later than the watermark are left out."""
    events = _late(events, watermark)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """user_id, start, n of each user's sessions, which end after a gap without events."""
    events = _late(events, watermark)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_of_kind(events: DataFrame, *keys: str, watermark: str) -> DataFrame:
    """The first row of each key within the watermark's horizon; state older than that is dropped."""
    return _late(events, watermark).dropDuplicatesWithinWatermark(list(keys))
