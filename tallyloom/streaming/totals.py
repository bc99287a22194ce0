"""Totals per window over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, ts: str, group: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and value per group and tumbling window; a batch or a streaming frame.

    On a stream, rows later than ``late`` are dropped and a window is emitted
    once the watermark has passed it; state is one row per open window and group.
    Rows without a time are in no window and drop out.
    """
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", window), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), group, "n", "total")
