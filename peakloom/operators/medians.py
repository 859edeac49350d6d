"""Exact medians of groups of any size, without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled

#: Groups of more values are refined; those of fewer are left to the built-in median, which holds them whole.
LARGE = 100_000
PARTS = 4096


def medians(rows: DataFrame, by: Sequence[str], values: Mapping[str, Column], large: int = LARGE) -> DataFrame:
    """by and the median of each of values, nulls left out (null where nothing is left; NaN counts as larger than any number).

    A large group's values are counted by sign and power of two first, then by PARTS equal parts of the range that holds the middle, again and
    again, until that range is one value. Each round keeps the rows of the range only, so the second already reads few.
    """
    by = list(by)
    own = rows.select(*by, *(v.cast("double").alias(name) for name, v in values.items()))
    plain = lambda df: df.groupBy(*by).agg(*(F.median(name).alias(name) for name in values))
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > large).select(*by)
    if sizes.isEmpty():
        return plain(own)
    sizes = settled(sizes)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in by]
    big = own.join(sizes, same(own, sizes), "left_semi")
    return plain(own.join(sizes, same(own, sizes), "left_anti")).unionByName(_refined(big, by, list(values)))


def with_medians(stats: DataFrame, rows: DataFrame, by: Sequence[str], values: Mapping[str, Column], large: int = LARGE) -> DataFrame:
    """stats, one row for each group of rows, with the medians."""
    middle = medians(rows, by, values, large).withColumnsRenamed({k: f"__of_{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in by]
    return stats.join(middle, on).drop(*(f"__of_{k}" for k in by))


def has_large(rows: DataFrame, by: Sequence[str], large: int = LARGE) -> bool:
    """Whether a group has too many rows to be held whole."""
    return not rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > large).isEmpty()


def _refined(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    key = F.struct(*by)
    long = rows.select(key.alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), (F.col(c) + 0.0).alias("v")) for c in names))).alias("e")).select("g", "e.name", "e.v").where("v is not null")
    at = ["g", "name", "rank"]
    counts = long.groupBy("g", "name").agg(F.count(F.lit(1)).alias("n"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = settled(counts.select("g", "name", F.explode(middle).alias("rank")).withColumn("ahead", F.col("rank")))
    v = F.col("v")
    power = F.when(F.isnan(v), 5000).when(v == 0, 0).otherwise(F.signum(v) * F.floor(F.greatest(F.least(F.log2(F.abs(v)) + 1200, F.lit(4000.0)), F.lit(1.0))))
    rows, part, solved = long.join(state.select("g", "name", "rank"), ["g", "name"]), power.cast("int"), None
    while True:
        parts = rows.groupBy(*at, part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*at).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        found = parts.withColumn("upto", upto).join(state.select(*at, "ahead"), at).where((F.col("upto") > F.col("ahead")) & (F.col("upto") - F.col("n") <= F.col("ahead")))
        found = settled(found.select(*at, (F.col("ahead") - (F.col("upto") - F.col("n"))).alias("ahead"), "low", "high"))
        one = found.where(F.col("low") == F.col("high")).select(*at, F.col("low").alias("v"))
        solved = one if solved is None else solved.unionByName(one)
        state = found.where(F.col("low") != F.col("high"))
        if state.isEmpty():
            break
        rows = settled(rows.select(*at, "v").join(state.select(*at, "low", "high"), at).where((v >= F.col("low")) & (v <= F.col("high"))))
        # all of one sign and power of two by now, so no difference overflows
        part = F.least(F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1)).cast("int")
    ends = solved.groupBy("g", "name").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    wide = ends.groupBy("g").agg(*(F.max(F.when(F.col("name") == c, F.col("a") + (F.col("b") - F.col("a")) / 2)).alias(c) for c in names))
    return wide.select("g.*", *names)
