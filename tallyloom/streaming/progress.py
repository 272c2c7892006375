"""Streaming: progress of a run as its results arrive, and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of values by event type and window, closed once the watermark has passed."""
    t = events.withWatermark("ts", late)
    return t.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def start(stream: DataFrame, path: str, checkpoint: str):
    """Process what is there and stop; a later start goes on from the checkpoint, each file once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
