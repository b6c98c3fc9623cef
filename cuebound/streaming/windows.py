"""Extensions on streams: windowed metrics of events and incremental segments (no counterpart is claimed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count, sum and mean of value per window and event_type; works on a stream (with a watermark) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def new_rows(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows of a stream without those whose key came before within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
