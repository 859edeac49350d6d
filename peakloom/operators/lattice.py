"""Compositions as lattice points: enumeration, nearest and within-tolerance joins, and subset models.

A lattice is the table of all compositions within the blocks' limits, with their masses. Its size depends on the blocks only, never on the peaks.
Peaks meet it by an equi-join on whole masses.

closest() and within() meet in the middle: only the lattice of the last blocks is a table, of HALF points at most. Each peak goes through the counts of the
blocks in front, in its own row and no farther than its mass reaches, and what is left of its mass is looked up in the table. So no number of blocks makes a
table of all compositions, and a few blocks need one lookup a peak.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import bit, block_bits, dot, doubles, total
from .storage import settled

MOST_ALTERNATIVES = 500
#: Points of the largest half lattice that is a table.
HALF = 50_000
#: Rows of lattice cells that are broadcast; they depend on the blocks alone. Of larger tables, the peaks are shuffled instead.
BROADCAST = 600_000
#: Points, counted for each model, of the largest whole lattice that closest_of_many() makes.
WHOLE = 5_000_000
#: Blocks that a model's mask, an int, can hold.
MASK_BITS = 31


def lattice(spark: SparkSession, masses: Sequence[float], limits: Sequence[int], heaviest: float | None = None) -> DataFrame:
    """(composition, mass): one explode a block, cut as soon as a partial mass passes heaviest."""
    rows = spark.createDataFrame([(0,)], "one int").select(F.array().cast("array<int>").alias("composition"), F.lit(0.0).alias("mass"))
    for m, most in zip(masses, limits):
        rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(int(most)))))
        rows = rows.select(F.concat("composition", F.array("n")).alias("composition"), (F.col("mass") + F.col("n") * F.lit(float(m))).alias("mass"))
        if heaviest is not None:
            rows = rows.where(F.col("mass") <= heaviest)
    return rows


def subset_masks(spark: SparkSession, names: Sequence[str], level: int = 2) -> DataFrame:
    """Mask, names, n_blocks of every non-empty subset; level 1 keeps those with the block named hex, if there is one."""
    k = len(names)
    if k > MASK_BITS:
        raise ValueError(f"{k} blocks; a model's mask holds {MASK_BITS}")
    bits = F.filter(F.transform(F.array(*map(F.lit, names)), lambda b, i: F.when(F.getbit(F.col("mask"), i) == 1, b)), lambda b: b.isNotNull())
    rows = spark.range(1, 2**k).select(F.col("id").cast("int").alias("mask")).withColumn("blocks", bits).withColumn("n_blocks", F.size("blocks"))
    at = [i for i, b in enumerate(names) if b.lower() == "hex"]
    return rows.where(F.getbit("mask", F.lit(at[0])) == 1) if level == 1 and at else rows


def prefix_masks(spark: SparkSession, names: Sequence[str], k_known: int) -> DataFrame:
    """The models of the first m blocks, m from k_known (at least 1) to all."""
    rows = spark.range(max(1, k_known), len(names) + 1).select(F.col("id").cast("int").alias("n_blocks"))
    return rows.select((bit(F.col("n_blocks")) - 1).alias("mask"), F.slice(F.array(*map(F.lit, names)), 1, F.col("n_blocks")).alias("blocks"), "n_blocks")


def model_lattice(points: DataFrame, masks: DataFrame) -> DataFrame:
    """(mask, composition, mass): a model's points use its blocks only. Both sides depend on the blocks alone."""
    points = points.withColumn("used", block_bits(F.col("composition")))
    return points.join(masks.select("mask"), F.col("used").bitwiseAND(F.bitwise_not("mask")) == 0).select("mask", "composition", "mass")


def _micro(mass: Column) -> Column:
    """In millionths: sums of the same masses in another order differ in the last bits."""
    return F.rint(mass * 1e6).cast("long")


def _hinted(cells: DataFrame, rows: int) -> DataFrame:
    """The lattice's side of a join. Without a hint, Spark takes rows that are still to be exploded for as small as their file, and may broadcast the peaks."""
    return F.broadcast(cells) if rows <= BROADCAST else cells.hint("merge")


def _cells(points: DataFrame, low: int, high: int, by: Sequence[str]) -> DataFrame:
    """Each distinct mass of a group with its neighbours, one row for each whole mass from low to high at which it can be nearest. Masses that agree to six decimals are
    one, that of the fewest copies."""
    best = points.groupBy(*by, _micro(F.col("mass")).alias("micro")).agg(F.min(F.struct(total(F.col("composition")).alias("copies"), "composition", "mass")).alias("p")).withColumn("mass", F.col("p.mass"))
    w = Window.partitionBy(*by).orderBy("mass")
    cells = best.select(*by, "mass", "p", F.lag("mass").over(w).alias("below"), F.lead("mass").over(w).alias("above"), (F.col("p") < F.lag("p").over(w)).alias("beats_below"), (F.col("p") < F.lead("p").over(w)).alias("beats_above"))
    middle = lambda other, slack: F.floor((F.col(other) + F.col("mass")) / 2 + slack).cast("long")
    first, last = F.coalesce(middle("below", -1e-6), F.lit(low)), F.coalesce(middle("above", 1e-6), F.lit(high))
    cells = cells.where(first <= last).withColumn("cell", F.explode(F.sequence(first, last)))
    return cells.select(*by, "cell", F.col("mass").alias("lattice_mass"), "p.composition", "below", "above", "beats_below", "beats_above")


def nearest(peaks: DataFrame, points: DataFrame, common: float, by: Sequence[str] = ()) -> DataFrame:
    """Each peak's nearest composition (in each group of points): composition, lattice_mass, error.

    Ties go to fewer copies, then the smaller composition. A peak meets the cells of its whole mass only, and keeps the one whose
    neighbours are farther off: one row for each peak and group, without a shuffle of peaks while the cells are small enough to broadcast.
    A peak beyond the lattice meets its outermost cell, so the cells depend on the blocks alone.
    """
    y = peaks.withColumn("target", F.col("observed") - common)
    ends = points.agg(F.min("mass"), F.max("mass")).first()  # of the lattice
    low, high = (math.floor(ends[0]) - 1, math.floor(ends[1]) + 1) if ends[0] is not None else (0, 0)
    cells = _cells(points, low, high, list(by))
    cell = F.least(F.greatest(F.floor("target").cast("long"), F.lit(low)), F.lit(high))
    met = y.withColumn("cell", cell).where(F.col("target").isNotNull()).join(cells, "cell").withColumn("error", F.abs(F.col("target") - F.col("lattice_mass")))
    wins = lambda other, ties: F.col(other).isNull() | (F.col("error") < F.abs(F.col("target") - F.col(other))) | ((F.col("error") == F.abs(F.col("target") - F.col(other))) & F.col(ties))
    met = met.where(wins("below", "beats_below") & wins("above", "beats_above"))
    keep = [c for c in peaks.columns if c not in ("sample_id", "peak_id")]
    return met.select("sample_id", "peak_id", *by, *keep, "composition", "lattice_mass", "error")


def alternatives(peaks: DataFrame, points: DataFrame, common: float, tolerance: float, most: int = MOST_ALTERNATIVES) -> DataFrame:
    """All compositions whose mass is less than the tolerance from a peak, the first `most` in composition order, then ranked
    by error. A peak without any has one of zeros with infinite error."""
    width = points.select(F.col("composition").alias("any")).limit(1)
    y = peaks.withColumn("target", F.col("observed") - common).withColumn("cell", F.floor("target").cast("long"))
    met = y.join(_tolerance_cells(points, tolerance), "cell").withColumn("error", F.abs(F.col("target") - F.col("mass"))).where(F.col("error") < tolerance)
    ranked = _ranked(met, most)
    return ranked.unionByName(_without(peaks.join(F.broadcast(width)), ranked, F.array_repeat(F.lit(0), F.size("any"))))  # one row


def _tolerance_cells(points: DataFrame, tolerance: float, slack: float = 1e-6) -> DataFrame:
    """points, one row for each whole mass at which one can be within the tolerance."""
    return points.withColumn("cell", F.explode(F.sequence(F.floor(F.col("mass") - tolerance - slack).cast("long"), F.floor(F.col("mass") + tolerance + slack).cast("long"))))


def _ranked(met: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("sample_id", "peak_id").orderBy("composition")
    kept = met.withColumn("dfs", F.row_number().over(order)).where(F.col("dfs") <= most)
    ranked = kept.withColumn("alternative", F.row_number().over(Window.partitionBy("sample_id", "peak_id").orderBy("error", "dfs")))
    return ranked.select("sample_id", "peak_id", "observed", "alternative", "composition", "error")


def _without(peaks: DataFrame, ranked: DataFrame, zeros: Column) -> DataFrame:
    """Peaks without an alternative get the empty composition."""
    left = peaks.join(ranked.where("alternative = 1").select("sample_id", "peak_id"), ["sample_id", "peak_id"], "left_anti")
    return left.select("sample_id", "peak_id", "observed", F.lit(1).alias("alternative"), zeros.alias("composition"), F.lit(float("inf")).alias("error"))


def split_at(limits: Sequence[int], most: int = HALF) -> int:
    """How many blocks are in front: the lattice of those behind has at most `most` points."""
    size, at = 1, len(limits)
    while at and size * (int(limits[at - 1]) + 1) <= most:
        at -= 1
        size *= int(limits[at]) + 1
    return at


def _fronts(peaks: DataFrame, masses: Sequence[float], limits: Sequence[int], slack: float) -> DataFrame:
    """Each peak (with target) once for each choice of counts: front, left (their mass). With masses above 0, no sum passes the target by more than the slack."""
    rows = peaks.select("*", F.array().cast("array<int>").alias("front"), F.lit(0.0).alias("left"))
    bounded = all(m > 0 for m in masses)
    for m, most in zip(masses, limits):
        reach = F.floor((F.greatest("target", F.lit(0.0)) + F.lit(slack) - F.col("left")) / F.lit(float(m))) if bounded else F.lit(int(most))
        rows = rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.greatest(reach, F.lit(0)), F.lit(int(most))).cast("int"))))
        rows = rows.withColumns({"front": F.array_append("front", F.col("n")), "left": F.col("left") + F.col("n") * F.lit(float(m))}).drop("n")
    return rows


def closest(peaks: DataFrame, masses: Sequence[float], limits: Sequence[int], common: float, masks: DataFrame | None = None, half: int = HALF, wanted: DataFrame | None = None) -> DataFrame:
    """nearest() over the lattice of all blocks, or of each model's (mask), met in the middle: composition, lattice_mass, error.

    wanted (sample_id, mask): only these models, of masks, are fitted.

    The mass of a composition is that of its front plus that of its back. With no block in front, the lookup is the result; else the best of a
    peak's lookups is, found before anything is shuffled.
    """
    spark, at = peaks.sparkSession, split_at(limits, half)
    back = lattice(spark, masses[at:], limits[at:])
    ends = [m * n for m, n in zip(masses[at:], limits[at:])]
    low, high = math.floor(sum(min(e, 0.0) for e in ends)) - 1, math.floor(sum(max(e, 0.0) for e in ends)) + 1
    by = [] if masks is None else ["mask"]
    if masks is not None:
        back = model_lattice(back, masks.select(F.call_function("shiftright", "mask", F.lit(at)).alias("mask")).distinct())
    models = 1 if masks is None else 2 ** min(len(masses) - at, MASK_BITS)
    cells = _hinted(_cells(back, low, high, by), 2 * math.prod(int(n) + (1 if masks is None else 2) for n in limits[at:]) + models * (high - low + 1))
    y = peaks.withColumn("target", F.col("observed") - common).where(F.col("target").isNotNull())
    rows = _fronts(y, masses[:at], limits[:at], max(masses[:at], default=0.0)).withColumn("rest", F.col("target") - F.col("left"))
    rows = rows.withColumn("cell", F.least(F.greatest(F.floor("rest").cast("long"), F.lit(low)), F.lit(high)))
    if wanted is not None:
        sought = wanted.select("sample_id", F.call_function("shiftright", "mask", F.lit(at)).alias("mask")).distinct()
        met = rows.join(sought, "sample_id").join(cells, ["mask", "cell"])
    else:
        met = rows.join(cells, "cell")
    off = lambda c: F.abs(F.col("rest") - F.col(c))
    keep = [c for c in peaks.columns if c not in ("sample_id", "peak_id")]
    if not at:
        wins = lambda other, ties: F.col(other).isNull() | (off("lattice_mass") < off(other)) | ((off("lattice_mass") == off(other)) & F.col(ties))
        return met.where(wins("below", "beats_below") & wins("above", "beats_above")).select("sample_id", "peak_id", *by, *keep, "composition", "lattice_mass", off("lattice_mass").alias("error"))
    wins = lambda other: F.col(other).isNull() | (off("lattice_mass") <= off(other) + 1e-9)
    met = met.where(wins("below") & wins("above")).withColumn("lattice_mass", F.col("left") + F.col("lattice_mass"))
    met = met.withColumns({"composition": F.concat("front", "composition"), "error": F.abs(F.col("target") - F.col("lattice_mass"))})
    if masks is not None:
        met = met.withColumnRenamed("mask", "back_mask").withColumn("used", block_bits(F.col("front")))
        need = masks.select("mask", F.call_function("shiftright", "mask", F.lit(at)).alias("back_mask"), F.col("mask").bitwiseAND(F.lit((1 << at) - 1)).alias("front_mask"))
        best = F.min(F.struct(F.rint(F.col("error") * 1e6).alias("near"), total(F.col("composition")).alias("copies"), "composition", "error", "lattice_mass")).alias("best")
        met = met.groupBy("sample_id", "peak_id", "back_mask", "used").agg(best, *[F.first(c).alias(c) for c in keep])
        met = met.join(need, "back_mask").where(F.col("used").bitwiseAND(F.bitwise_not("front_mask")) == 0)
        if wanted is not None:
            met = met.join(wanted, ["sample_id", "mask"], "left_semi")
        found = met.groupBy("sample_id", "peak_id", "mask").agg(F.min("best").alias("best"), *[F.first(c).alias(c) for c in keep])
    else:
        best = F.min(F.struct(F.rint(F.col("error") * 1e6).alias("near"), total(F.col("composition")).alias("copies"), "composition", "error", "lattice_mass")).alias("best")
        found = met.groupBy("sample_id", "peak_id").agg(best, *[F.first(c).alias(c) for c in keep])
    return found.select("sample_id", "peak_id", *by, *keep, "best.composition", "best.lattice_mass", "best.error")


def fits_within(peaks: DataFrame, masses: Sequence[float], limits: Sequence[int], common: float, masks: DataFrame, tolerance: float, also: Sequence[Column] = (), half: int = HALF) -> DataFrame:
    """closest() of all models with one row for each peak: good, array<struct<mask, composition, error, ...>>, has those of its models' nearest compositions that are less than the
    tolerance away. also: named expressions over composition and the columns of masks.

    The cells of all models are one row for each whole mass, so a peak meets one row, and no fit is a row of its own. Only points within the tolerance of a whole mass are in its row.
    """
    named = F.broadcast(masks)
    if split_at(limits, half):
        rows = closest(peaks, masses, limits, common, masks, half=half).join(named, "mask")
        keep = [F.first(c).alias(c) for c in peaks.columns if c not in ("sample_id", "peak_id")]
        return rows.groupBy("sample_id", "peak_id").agg(*keep, F.collect_list(F.when(F.col("error") < tolerance, F.struct("mask", "composition", "error", *also))).alias("good"))
    ends = [m * n for m, n in zip(masses, limits)]
    low, high = math.floor(sum(min(e, 0.0) for e in ends) - tolerance) - 1, math.floor(sum(max(e, 0.0) for e in ends) + tolerance) + 1
    cells = _cells(model_lattice(lattice(peaks.sparkSession, masses, limits), masks), low, high, ["mask"])
    reached = (F.col("lattice_mass") > F.col("cell") - tolerance - 1e-6) & (F.col("lattice_mass") < F.col("cell") + 1 + tolerance + 1e-6)
    cells = cells.where(reached).join(named, "mask").select("cell", F.struct("mask", "composition", "lattice_mass", "below", "above", "beats_below", "beats_above", *also).alias("met"))
    cells = cells.groupBy("cell").agg(F.collect_list("met").alias("met"))
    y = peaks.withColumn("target", F.col("observed") - common).where(F.col("target").isNotNull()).withColumn("cell", F.least(F.greatest(F.floor("target").cast("long"), F.lit(low)), F.lit(high)))
    off = lambda m: F.abs(F.col("target") - m)
    wins = lambda m, other, ties: m[other].isNull() | (off(m["lattice_mass"]) < off(m[other])) | ((off(m["lattice_mass"]) == off(m[other])) & m[ties])
    near = F.filter("met", lambda m: (off(m["lattice_mass"]) < tolerance) & wins(m, "below", "beats_below") & wins(m, "above", "beats_above"))
    extra = cells.schema["met"].dataType.elementType.names[7:]
    good = F.transform(near, lambda m: F.struct(m["mask"].alias("mask"), m["composition"].alias("composition"), off(m["lattice_mass"]).alias("error"), *(m[c].alias(c) for c in extra)))
    return y.join(F.broadcast(cells), "cell", "left").select(*peaks.columns, F.coalesce(good, F.array()).alias("good"))


def closest_of_many(peaks: DataFrame, masses: Sequence[float], limits: Sequence[int], common: float, masks: DataFrame | None = None, most: int = WHOLE) -> DataFrame:
    """closest() for many peaks and blocks, by one lookup for each peak and model instead of one for each choice of counts in front.

    The whole lattice is a table here, as far as the heaviest peak reaches. Its cells are as narrow as a model's points are dense, so that a peak meets few points, and both
    sides are dealt out by model and cell. A lattice of more than `most` points is left to closest(), and so are masses that are not above 0.
    """
    spark, by = peaks.sparkSession, [] if masks is None else ["mask"]
    if math.prod(int(n) + (1 if masks is None else 2) for n in limits) > most or min(masses, default=0.0) <= 0:
        return closest(peaks, masses, limits, common, masks)
    y = peaks.withColumn("target", F.col("observed") - common).where(F.col("target").isNotNull())
    # The first point above a target is at most one block above it.
    heaviest = y.where(~F.isnan("target")).agg(F.max(F.least("target", F.lit(float(sum(m * n for m, n in zip(masses, limits))))))).first()[0]
    heaviest = max(heaviest or 0.0, 0.0) + max(masses) + 1
    points = lattice(spark, masses, limits, heaviest).repartition("composition")
    if masks is not None:
        points = points.withColumn("used", block_bits(F.col("composition"))).join(F.broadcast(masks.select("mask")), F.col("used").bitwiseAND(F.bitwise_not("mask")) == 0)
    best = points.groupBy(*by, _micro(F.col("mass")).alias("micro")).agg(F.min(F.struct(total(F.col("composition")).alias("copies"), "composition", "mass")).alias("p")).withColumn("mass", F.col("p.mass"))
    best = settled(best.drop("micro"))
    scale = F.pow(F.lit(2.0), F.rint(F.log2(F.count(F.lit(1)) / F.lit(heaviest))))
    scales = best.groupBy(*by).agg(scale.alias("scale")) if by else best.agg(scale.alias("scale"))
    w = Window.partitionBy(*by).orderBy("mass")
    cells = best.select(*by, "mass", "p", F.lag("mass").over(w).alias("below"), F.lead("mass").over(w).alias("above"), (F.col("p") < F.lag("p").over(w)).alias("beats_below"), (F.col("p") < F.lead("p").over(w)).alias("beats_above"))
    cells = cells.join(F.broadcast(scales), by) if by else cells.crossJoin(F.broadcast(scales))
    high = F.floor(F.lit(heaviest) * F.col("scale")).cast("long")
    middle = lambda other, slack: F.floor(((F.col(other) + F.col("mass")) / 2 + slack) * F.col("scale")).cast("long")
    first, last = F.coalesce(middle("below", -2e-6), F.lit(0).cast("long")), F.least(F.coalesce(middle("above", 2e-6), high), high)
    cells = cells.where(first <= last).withColumn("cell", F.explode(F.sequence(first, last)))
    cells = cells.select(*by, "cell", F.col("mass").alias("lattice_mass"), "p.composition", "below", "above", "beats_below", "beats_above")
    cell = F.least(F.greatest(F.floor(F.col("target") * F.col("scale")).cast("long"), F.lit(0).cast("long")), high)
    met = y.crossJoin(F.broadcast(scales)).withColumn("cell", cell).drop("scale").join(cells.hint("merge"), [*by, "cell"])
    off = lambda c: F.abs(F.col("target") - F.col(c))
    near = lambda c: F.rint(off(c) * 1e6)  # noqa: E731  errors that agree to six decimals are one
    wins = lambda other, ties: F.col(other).isNull() | (near("lattice_mass") < near(other)) | ((near("lattice_mass") == near(other)) & F.col(ties))
    keep = [c for c in peaks.columns if c not in ("sample_id", "peak_id")]
    return met.where(wins("below", "beats_below") & wins("above", "beats_above")).select("sample_id", "peak_id", *by, *keep, "composition", "lattice_mass", off("lattice_mass").alias("error"))


def within(peaks: DataFrame, masses: Sequence[float], limits: Sequence[int], common: float, tolerance: float, most: int = MOST_ALTERNATIVES, half: int = HALF) -> DataFrame:
    """alternatives() over the lattice of all blocks, met in the middle."""
    at = split_at(limits, half)
    y = peaks.withColumn("target", F.col("observed") - common)
    rows = _fronts(y.where(F.col("target").isNotNull()), masses[:at], limits[:at], tolerance)
    cells = _tolerance_cells(lattice(peaks.sparkSession, masses[at:], limits[at:]).withColumnRenamed("composition", "back"), tolerance)
    cells = _hinted(cells, math.prod(int(n) + 1 for n in limits[at:]) * (math.ceil(2 * tolerance) + 2))
    met = rows.withColumn("cell", F.floor(F.col("target") - F.col("left")).cast("long")).join(cells, "cell")
    met = met.withColumn("error", F.abs(F.col("target") - (F.col("left") + F.col("mass")))).where(F.col("error") < tolerance)
    ranked = _ranked(met.withColumn("composition", F.concat("front", "back")), most)
    return ranked.unionByName(_without(peaks, ranked, F.array_repeat(F.lit(0), len(limits))))


def reconstructed(rows: DataFrame, masses: Sequence[float], common: float | Column, tolerance: float) -> DataFrame:
    """Reconstructed, error and status of a composition; GOOD strictly below the tolerance."""
    recon = (F.lit(common) if not isinstance(common, Column) else common) + dot(F.col("composition"), doubles(masses))
    rows = rows.withColumn("reconstructed", recon).withColumn("error", F.abs(F.col("observed") - F.col("reconstructed")))
    return rows.withColumn("status", F.when(F.col("error") < tolerance, "GOOD").otherwise("BAD"))


def ambiguity(alts: DataFrame) -> DataFrame:
    """Per peak the number of alternatives, the best error and the margin to the second (null without one)."""
    return alts.where(F.col("error") < float("inf")).groupBy("sample_id", "peak_id").agg(
        F.count(F.lit(1)).alias("n_alternatives"), F.min("error").alias("best_error"),
        (F.min(F.when(F.col("alternative") == 2, F.col("error"))) - F.min(F.when(F.col("alternative") == 1, F.col("error")))).alias("margin"),
    )


def ambiguity_summary(per_peak: DataFrame, clear: float = 0.5) -> DataFrame:
    """Peaks with one alternative, clear and ambiguous ones, and the margins; the median is the upper middle."""
    margins = per_peak.where(F.col("margin").isNotNull())
    w = Window.partitionBy("sample_id").orderBy("margin")
    ranked = margins.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("sample_id"))})
    return ranked.groupBy("sample_id").agg(
        F.count_if(F.col("margin") >= clear).alias("n_clear"), F.count_if(F.col("margin") < clear).alias("n_ambiguous"), F.min("margin").alias("min_margin"),
        F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("margin"))).alias("median_margin"), F.max("margin").alias("max_margin"),
    )
