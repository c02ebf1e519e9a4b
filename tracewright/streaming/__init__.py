"""Extension (the workload itself has no streams): windowed latency over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_latency(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and greatest value by event type and tumbling window, late rows within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
