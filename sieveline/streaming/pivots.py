"""Pivots over a stream of texts: mentions per window, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect


def mention_counts(texts: DataFrame, window: str = "10 minutes", late: str = "1 hour", types: set[str] | None = None) -> DataFrame:
    """window, type, normalized and count from a stream of (at, text)."""
    found = texts.withWatermark("at", late).select("at", F.explode(detect.mentions(F.col("text"), types)).alias("m"))
    return found.groupBy(F.window("at", window), "m.type", "m.normalized").agg(F.count("*").alias("count"))
