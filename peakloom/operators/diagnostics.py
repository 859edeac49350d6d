"""Residual diagnostics and block usage over the fact table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .medians import with_medians
from .storage import settled

TINY = 1e-20


def good(facts: DataFrame) -> DataFrame:
    """F7."""
    return facts.where(F.trim("status") == "GOOD")


def residual_statistics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """A12-A15, A17, A18 over rows (by..., observed, reconstructed): moments of the signed residuals, their line over mass, ppm errors and R2.

    Skewness and kurtosis divide by the sample deviation; too few values give 0, as does a spread of none.
    """
    rows = rows.withColumn("e", F.col("observed") - F.col("reconstructed"))
    ppm = F.when(F.col("observed") > 0, F.abs("e") / F.col("observed") * 1e6).otherwise(0.0)
    n, s = F.count("e"), F.stddev_samp("e")
    stats = rows.groupBy(*by).agg(
        n.alias("n"), F.avg("e").alias("mean"), F.coalesce(s, F.lit(0.0)).alias("std"), F.min("e").alias("low"), F.max("e").alias("high"),
        F.skewness("e").alias("g1"), F.kurtosis("e").alias("g2"),
        F.regr_slope("e", "observed").alias("b1"), F.regr_intercept("e", "observed").alias("b0"), F.regr_sxx("e", "observed").alias("sxx"), F.regr_syy("e", "observed").alias("syy"), F.regr_sxy("e", "observed").alias("sxy"),
        F.avg(ppm).alias("ppm_mean"), F.max(ppm).alias("ppm_max"),
        F.sum(F.col("e") * F.col("e")).alias("rss"), (F.var_pop("observed") * n).alias("tss"),
    )
    stats = with_medians(stats, rows, by, {"median": F.col("e"), "ppm_median": ppm})
    m = F.col("n")
    line = (m >= 3) & (F.col("sxx") >= TINY)
    left = F.greatest(F.col("syy") - F.col("b1") * F.col("sxy"), F.lit(0.0))
    t = F.abs(F.col("b1")) / F.sqrt(left / (m - 2) / F.col("sxx"))
    # In SQL NaN moments come from a spread of none.
    spread = F.col("std") >= 1e-15
    return stats.select(
        *by, "n", "mean", "median", "std", "low", "high",
        F.when((m >= 3) & spread, F.col("g1") * F.pow((m - 1) / m, F.lit(1.5))).otherwise(0.0).alias("skewness"),
        F.when((m >= 4) & spread, (F.col("g2") + 3) * F.pow((m - 1) / m, F.lit(2.0)) - 3).otherwise(0.0).alias("kurtosis"),
        F.when(line, F.col("b1")).otherwise(0.0).alias("slope"), F.when(line, F.col("b0")).otherwise(F.col("mean")).alias("intercept"),
        F.when(line & (F.col("syy") > TINY), F.greatest(1 - left / F.col("syy"), F.lit(0.0))).otherwise(0.0).alias("line_r2"),
        F.when(line & (left > 0), t > 2).otherwise(line & (F.col("b1") != 0) & (left <= 0) & (F.col("syy") > TINY)).alias("biased"),
        "ppm_mean", "ppm_median", "ppm_max", F.when(F.col("tss") > TINY, F.greatest(1 - F.col("rss") / F.col("tss"), F.lit(0.0))).otherwise(0.0).alias("r2"),
    )


def _outer(n: int, ssq: float, m: list[float]) -> tuple[float, list[float]]:
    """Royston's weights: the divisor of the inner normal scores, and the weights of the highest value and, from 6 values on, the next; m: their scores."""
    u = 1 / math.sqrt(n)
    # Royston's polynomials for the outer weights.
    last = float(np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[0] / math.sqrt(ssq)], u))
    if n <= 5:
        return math.sqrt((ssq - 2 * m[0] ** 2) / (1 - 2 * last**2)), [last]
    second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[1] / math.sqrt(ssq)], u))
    return math.sqrt((ssq - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * last**2 - 2 * second**2)), [last, second]


def w_from_sums(n: int, ssq: float, scored: float, spread: float, low: list[float], high: list[float]) -> tuple[float | None, float | None]:
    """Shapiro-Wilk W and p from sums over ordered values: of squared scores, of score x value, of squared distances from the mean; and the two outer values of
    either side, the outermost first."""
    if n < 3 or high[0] - low[0] < 1e-19:
        return None, None
    if n == 3:
        total = math.sqrt(0.5) * (high[0] - low[0])
    else:
        m = [NormalDist().inv_cdf((n - k - 0.375) / (n + 0.25)) for k in (0, 1)]
        root, outer = _outer(n, ssq, m)
        total = scored / root
        for k, weight in enumerate(outer):
            total += (weight - m[k] / root) * (high[k] - low[k])
    return _p_value(min(1.0, total**2 / spread), n)


def _p_value(w: float, n: int) -> tuple[float, float]:
    """W and its p."""
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    # Royston's mean and deviation of the transformed W.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    inverse = NormalDist().inv_cdf
    for b in batches:
        b["score"] = [inverse(p) for p in (b["place"].to_numpy() - 0.375) / (b["m"].to_numpy() + 0.25)]
        yield b


def normality(rows: DataFrame, by: Sequence[str], most: int | None = None) -> DataFrame:
    """A16 for each group of rows (by..., observed, reconstructed): W, p, p > 0.05, and whether p is beyond the 5000 values that its approximation was fitted on.
    With `most`, groups of more values get nulls.

    No group is gathered: values are ordered over ranges, places are those within a range after the sizes of the ranges before, and W comes from sums.
    """
    e = F.col("observed") - F.col("reconstructed")
    sized = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    values = rows.select(*by, e.cast("double").alias("e")).where(F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") < float("inf")))
    values = settled(values.repartitionByRange(*by, "e").withColumn("part", F.spark_partition_id()))
    parts = values.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("size"), F.sum("e").alias("sum"))
    before, whole = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    parts = parts.select(*by, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"), F.sum("size").over(whole).alias("m"), (F.sum("sum").over(whole) / F.sum("size").over(whole)).alias("mean"))
    placed = values.withColumn("k", F.row_number().over(Window.partitionBy(*by, "part").orderBy("e"))).join(parts, [*by, "part"])
    placed = placed.select(*by, (F.col("e") - F.col("mean")).alias("d"), (F.col("ahead") + F.col("k")).alias("place"), "m")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", score double"
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("d")))
    sums = placed.mapInPandas(_scores, schema).groupBy(*by).agg(
        F.max("m").alias("m"), F.sum(F.col("score") * F.col("score")).alias("ssq"), F.sum(F.col("score") * F.col("d")).alias("scored"), F.sum(F.col("d") * F.col("d")).alias("spread"),
        F.array(at(F.lit(1)), at(F.lit(2))).alias("low"), F.array(at(F.col("m")), at(F.col("m") - 1)).alias("high"),
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tested = [w_from_sums(*x) for x in zip(*(b[c] for c in ("m", "ssq", "scored", "spread", "low", "high")))]
            yield b[list(by)].assign(w=[w for w, _ in tested], p=[p for _, p in tested]).astype({"w": float, "p": float})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    tests = sums.mapInPandas(finish, f"{keys}, w double, p double")
    tests = tests.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("w", "p")})
    if most is not None:
        tests = tests.join(sized.where(F.col("n") <= most).select(*by), list(by), "left_semi")
    return sized.join(tests, list(by), "left").withColumns({"normality_ok": F.col("p") > 0.05, "beyond_fit": F.col("n") > 5000})


def usage_by_block(rows: DataFrame, by: Sequence[str], block_names: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """Per block the peaks that use it, their share, mean copies when used, most copies, and whether few peaks use it; with mass and
    type from blocks (name, value, type), type known without an entry."""
    each = rows.select(*by, F.posexplode("composition").alias("ord", "copies")).withColumn("block", F.get(F.array(*map(F.lit, block_names)), F.col("ord")))
    used = F.col("copies") > 0
    stats = each.groupBy(*by, "ord", "block").agg(F.count(F.lit(1)).alias("n_good"), F.count_if(used).alias("n_used"), F.avg(F.when(used, F.col("copies"))).alias("mean_copies"), F.max("copies").alias("max_copies"))
    stats = stats.withColumns({"share": F.col("n_used") / F.col("n_good"), "mean_copies": F.coalesce("mean_copies", F.lit(0.0)), "flagged": (F.col("n_used") <= 2) & (F.col("n_good") > 5)})
    if blocks is None:
        return stats
    return stats.join(blocks.select(F.col("name").alias("block"), F.col("value").alias("mass"), "type"), "block", "left").withColumn("type", F.coalesce("type", F.lit("known")))


def blocks_per_peak(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and most kinds of blocks on a peak, and peaks with none."""
    kinds = F.size(F.filter("composition", lambda n: n > 0))
    return rows.select(*by, kinds.alias("k")).groupBy(*by).agg(F.avg("k").alias("mean_blocks"), F.max("k").alias("max_blocks"), F.count_if(F.col("k") == 0).alias("common_only"))


def cooccurrence(rows: DataFrame, by: Sequence[str], block_names: Sequence[str]) -> DataFrame:
    """Peaks on which two blocks stand together. Pairs come from each composition, without a join."""
    names = F.array(*map(F.lit, block_names))
    present = F.filter(F.transform("composition", lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    pairs = F.flatten(F.transform(present, lambda i: F.transform(F.filter(present, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    each = rows.select(*by, F.explode(pairs).alias("p"))
    counts = each.groupBy(*by, "p.i", "p.j").agg(F.count(F.lit(1)).alias("n_peaks"))
    return counts.select(*by, F.get(names, F.col("i")).alias("block_a"), F.get(names, F.col("j")).alias("block_b"), "n_peaks")


def model_blocks(facts: DataFrame, block_names: Sequence[str]) -> DataFrame:
    """A model's blocks: the parts of its label if all are blocks, else the blocks that any of its rows counts."""
    names = F.array(*map(F.lit, block_names))
    parts = F.split("model", r"\+")
    any_count = facts.groupBy("model").agg(*[F.max(F.get("composition", F.lit(i))).alias(f"m{i}") for i in range(len(block_names))])
    counted: Column = F.filter(F.array(*[F.when(F.col(f"m{i}") > 0, F.lit(b)) for i, b in enumerate(block_names)]), lambda b: b.isNotNull())
    return any_count.select("model", F.when(F.forall(parts, lambda p: F.array_contains(names, p)), parts).otherwise(counted).alias("blocks"))
