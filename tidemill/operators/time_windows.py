"""Counts in time windows and sessions; the same code serves a table and a stream.

Null timestamps or users: a null timestamp belongs to no window and is left out,
a null user is a group of its own. Repeated rows count each time. A table's sessions
are found day by day first, so that all events of one user, or of the null user, don't
meet in one task; only their sessions do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_time(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """``ts`` as timestamp (a watermark takes no timestamp_ntz), with a watermark on a stream."""
    out = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return out.withWatermark("ts", watermark) if watermark else out


def window_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events and cents of value for each user and window; tumbling, or sliding when ``slide`` is given."""
    grouped = events.groupBy("user_id", F.window("ts", width, slide) if slide else F.window("ts", width))
    return grouped.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("value").cast("decimal(18,4)")).alias("sum_value"),
    ).select(
        "user_id",
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        "n_events",
        F.col("sum_value").cast("decimal(38,4)").alias("sum_value"),
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions: runs of events at most ``gap`` apart."""
    return (
        events.groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))
        .select(
            "user_id",
            F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
            F.col("last_ts").cast("timestamp_ntz").alias("last_ts"),
            "n_events",
        )
    )


def table_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """What sessions() gives, for a table: each user's sessions of a day, which are then united where they are at most ``gap`` apart."""
    daily = events.where(F.col("ts").isNotNull()).groupBy("user_id", F.to_date("ts").alias("day"), F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    in_order = Window.partitionBy("user_id").orderBy("first_ts")
    begins = F.coalesce(F.col("first_ts") > F.lag("last_ts").over(in_order) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = daily.withColumn("begins", begins.cast("int")).withColumn("session", F.sum("begins").over(in_order))
    return (
        numbered.groupBy("user_id", "session")
        .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events"))
        .select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("session_start"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n_events")
    )
