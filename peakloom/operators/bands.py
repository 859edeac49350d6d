"""Lookups of a value in a table of masses within a window.

The table (a dictionary, or masses derived from one) is turned into one row per integer mass, holding the entries whose window
touches it in their order. Values then need an equi-join on floor(value), one row each, and an array filter; nothing is multiplied
and Spark may broadcast the table by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bands(entries: DataFrame, window: float, *payload: str) -> DataFrame:
    """(cell, entries array<struct<ord, mass, payload...>>), in order; entries has ord and mass."""
    cells = F.explode(F.sequence(F.floor(F.col("mass") - window).cast("long"), F.floor(F.col("mass") + window).cast("long")))
    rows = entries.select(cells.alias("cell"), F.struct("ord", "mass", *payload).alias("entry"))
    return rows.groupBy("cell").agg(F.sort_array(F.collect_list("entry")).alias("entries"))


def with_first(rows: DataFrame, value: Column, entries: DataFrame, window: float, *payload: str, into: str = "hit") -> DataFrame:
    """rows with the first entry (by ord, not by distance) whose mass is less than the window away, or null."""
    table = bands(entries, window, *payload).withColumnRenamed("entries", "__entries").withColumnRenamed("cell", "__cell")
    near = F.filter("__entries", lambda e: F.abs(F.col("__value") - e["mass"]) < window)
    joined = rows.withColumn("__value", value).withColumn("__at", F.floor(value).cast("long")).join(table, F.col("__at") == F.col("__cell"), "left")
    return joined.withColumn(into, F.get(near, 0)).drop("__value", "__at", "__cell", "__entries")
