"""Event-time windows; the same functions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark on ``ts``; times without a zone are of the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """(start, event_type, n, total) of windows that do not overlap."""
    rows = timed(events, late).groupBy(F.window("ts", size), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    """(start, n) of windows that start every ``step``."""
    rows = timed(events, late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(user_id, start, finish, n): a user's events no further apart than ``gap``."""
    rows = timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """First event of each key within the watermark; in a batch, of each key."""
    if events.isStreaming:
        return timed(events, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
