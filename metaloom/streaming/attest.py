"""Attestation counts over an event stream (an extension; the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Counts and value sums by tumbling window and type; events later than ``late`` are dropped in append mode."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
