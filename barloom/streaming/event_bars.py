"""Bars from a stream of events: tumbling windows with a watermark, so that state is bounded and late rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(event_type, start, open, high, low, close, n) of events (ts, event_type, event_id, value), streaming or not."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    order = F.struct("ts", "event_id")
    bars = timed.groupBy("event_type", F.window("ts", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")
    )
    return bars.select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
