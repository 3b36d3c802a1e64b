"""The event jobs over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemill.operators.time_windows import event_time, sessions, window_counts


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Window counts; rows later than ``late`` behind the newest event are left out."""
    return window_counts(event_time(events, late), width, slide)


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions; rows later than ``late`` behind the newest event are left out."""
    return sessions(event_time(events, late), gap)
