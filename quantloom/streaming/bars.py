"""Bars over a stream of events, by event time with a watermark; the same code runs on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Open, high, low, close and count of `value` by type and window."""
    # a watermark needs a timestamp with a zone
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    k = F.struct("ts", "event_id")
    return (
        timed.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("start_ts"), "event_type", "open", "high", "low", "close", "n_events")
    )
