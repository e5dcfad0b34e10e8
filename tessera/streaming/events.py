"""Windowed counts and deduplication of event streams with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, time: str, size: str, delay: str, by: str, value: str) -> DataFrame:
    """Count and sum by tumbling window and key; late events beyond the watermark are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
