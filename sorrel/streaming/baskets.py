"""Running basket counts of items over a stream of (stock, basket_id, ts) lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_item_counts(lines: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, stock, n): lines by time window and item. State older than the watermark is dropped."""
    return lines.withWatermark("ts", late).groupBy(F.window("ts", window), "stock").agg(F.count(F.lit(1)).alias("n"))
