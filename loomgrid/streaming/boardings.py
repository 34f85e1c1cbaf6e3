"""Boardings by station and hour from a stream of events, with late rows up to a watermark.

The batch operators have no streaming counterpart to match; this is the natural form of the hourly
totals where boardings arrive continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_boardings(events: DataFrame, lateness: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """``window_start, station_id, boardings, riders`` over tumbling windows of ``ts``.

    ``events`` has ``ts, station_id, boardings``; it may be a stream or a table. Rows later than ``lateness`` are dropped by
    a stream only.
    """
    marked = events.withWatermark("ts", lateness)
    counted = marked.groupBy(F.window("ts", window).alias("w"), "station_id").agg(F.sum("boardings").alias("boardings"), F.count(F.lit(1)).alias("riders"))
    return counted.select(F.col("w.start").alias("window_start"), "station_id", "boardings", "riders")
