"""Daily bars of an event stream. An extension: the batch side has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of event files (event_id, ts, user_id, event_type, value, props)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_bars(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(event_type, day, open, high, low, close, n) per day; rows later than ``lateness``
    are dropped, so the state holds the open days only. Works on batches too."""
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", lateness)
    at = F.struct("ts", "event_id")
    bars = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n")
    )
    return bars.select("event_type", F.col("w.start").cast("date").alias("day"), "open", "high", "low", "close", "n")
