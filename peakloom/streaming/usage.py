"""Usage counts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.usage import SCHEMA


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of the usage log as they arrive."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def running_totals(events: DataFrame) -> DataFrame:
    """A25 over a stream; write in complete or update mode."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A27 over a stream: counts by window and kind; events later than the watermark are left out, and closed windows are dropped from state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
