"""Graph aggregates that follow a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str = "ts", watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, src, n, weight) of streamed (ts, src, dst, w); late edges up to the watermark are counted."""
    return edges.withWatermark(time, watermark).groupBy(F.window(time, window), "src").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))
