"""Counts over streams of regions: the batch operators F1 and F8 under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbispan.functions.regions import midpoint


def sample_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes", by: str = "sample") -> DataFrame:
    """window, sample and count; rows later than `late` are dropped, so state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("count"))


def tile_counts(stream: DataFrame, size: int, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window, chrom, idx and count of midpoints."""
    tiled = stream.withColumn("idx", F.floor(midpoint() / size))
    return tiled.withWatermark(time, late).groupBy(F.window(time, window), "chrom", "idx").agg(F.count(F.lit(1)).alias("count"))
