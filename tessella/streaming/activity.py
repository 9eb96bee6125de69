"""Tumbling-window activity as a stream: the same aggregation, with event time and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, event_type, n, mean) of events(ts, event_type, value); rows later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
