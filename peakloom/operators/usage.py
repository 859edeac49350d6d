"""Reports over usage events (id, kind, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame) -> DataFrame:
    """A25."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def span(events: DataFrame) -> DataFrame:
    """A26."""
    return events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def recent(events: DataFrame, most: int = 20) -> DataFrame:
    """T3."""
    return events.orderBy(F.col("id").desc()).limit(most)


def daily(events: DataFrame) -> DataFrame:
    """A27."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


def busiest_days(events: DataFrame, most: int = 5) -> DataFrame:
    """The days with most events, the earlier first among equals."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "day").limit(most)
