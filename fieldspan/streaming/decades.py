"""Strict ten-day sums over an event stream: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_decades(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """pixel, window, days, total: sums of ``value`` by user group and ten days of event time.

    Works on streams (a window closes once the watermark passes it) and on tables. ``days`` tells how
    many days had events, so a reader can take whole windows only.
    """
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy((F.col("user_id") % 20).cast("int").alias("pixel"), F.window("ts", "10 days").alias("window")).agg(
        F.size(F.collect_set(F.to_date("ts"))).alias("days"), F.sum("value").alias("total")
    )
