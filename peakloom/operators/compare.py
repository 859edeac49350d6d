"""Comparison of subset models over their fits.

fits: (sample_id, mask, peak_id, observed, composition, error); models: one row per (sample_id, mask).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bic, doubles, total
from .lattice import closest, fits_within, subset_masks
from .medians import LARGE, has_large, with_medians
from .storage import settled


def model_summary(fits: DataFrame, masks: DataFrame, tolerance: float, large: int = LARGE) -> DataFrame:
    """N, n_good, n_bad, rss, median_error and BIC of each model, with its blocks.

    Squares are added from the least error on, so models of equal errors tie whatever order their rows come in; models of more than `large` peaks are added up as they come."""
    e, by = F.col("error"), ["sample_id", "mask"]
    if has_large(fits, by, large):
        sums = [F.count(F.lit(1)).alias("n"), F.count_if(e < tolerance).alias("n_good"), F.count_if(e >= tolerance).alias("n_bad"), F.sum(e * e).alias("rss")]
        stats = with_medians(fits.groupBy(*by).agg(*sums), fits, by, {"median_error": e}, large)
    else:
        n, at = F.size("__e"), lambda i: F.get("__e", F.floor(i).cast("int"))
        stats = fits.groupBy(*by).agg(F.sort_array(F.collect_list(e)).alias("__e")).select(
            *by, n.cast("long").alias("n"), F.size(F.filter("__e", lambda x: x < tolerance)).cast("long").alias("n_good"), F.size(F.filter("__e", lambda x: x >= tolerance)).cast("long").alias("n_bad"),
            F.aggregate("__e", F.lit(0.0), lambda total, x: total + x * x).alias("rss"), ((at((n - 1) / 2) + at(n / 2)) / 2).alias("median_error"),
        )
    models = stats.join(F.broadcast(masks.select("mask", "blocks", "n_blocks")), "mask")
    return models.withColumns({"bic": bic(F.col("n"), F.col("rss"), F.col("n_blocks")), "model": F.array_join("blocks", "+")})


def without_supersets(models: DataFrame) -> DataFrame:
    """models that contain no other perfect model. A level at a time or at once is the same: a perfect subset that is
    itself skipped has a perfect subset of its own."""
    perfect = F.collect_set(F.when(F.col("n_bad") == 0, F.col("mask"))).over(Window.partitionBy("sample_id"))
    part = F.exists("__perfect", lambda p: (p != F.col("mask")) & (F.col("mask").bitwiseAND(p) == p))
    return models.withColumn("__perfect", perfect).where(~part).drop("__perfect")


def of_models(fits: DataFrame, models: DataFrame, *columns: str) -> DataFrame:
    """fits of the models only, with columns of these. The models are looked up in one row for each sample, so fits that are dealt out by sample stay where they are."""
    entries = F.collect_list(F.struct("mask", F.struct("mask", *columns).alias("m")))
    kept = models.groupBy("sample_id").agg(F.map_from_entries(entries).alias("__kept"))
    rows = fits.join(kept, "sample_id").withColumn("__m", F.col("__kept")[F.col("mask")]).where(F.col("__m").isNotNull())
    return rows.select(*fits.columns, *(F.col(f"__m.{c}").alias(c) for c in columns))


def level_search(peaks: DataFrame, names: Sequence[str], masses: Sequence[float], limits: Sequence[int], common: float, tolerance: float, level: int = 2) -> tuple[DataFrame, DataFrame]:
    """F9, G2, level by level: the fits and models of without_supersets(), of which no other is fitted.

    Models of one size are fitted for the samples that still need them. A larger one is tried if all the smaller ones that it is made from were tried and none was perfect:
    it comes from each of these by adding a block, so it is counted, and no model is compared with another.
    """
    k = len(names)
    masks = subset_masks(peaks.sparkSession, names, level)
    hexes = [i for i, b in enumerate(names) if b.lower() == "hex"] if level == 1 else []
    always = 1 << hexes[0] if hexes else 0
    samples = peaks.select("sample_id").distinct()
    wanted = settled(samples.select("sample_id", F.explode(F.array(*(F.lit(always or 1 << i) for i in range(1 if always else k)))).alias("mask")))
    fits, models = [], []
    for size in range(1, k + 1):
        own = closest(peaks, masses, limits, common, masks, wanted=wanted)  # a lookup, cheaper to repeat than to store
        found = settled(model_summary(own, masks, tolerance))
        fits.append(own)
        models.append(found)
        if size == k:
            break
        more = found.where("n_bad > 0").select("sample_id", "mask", F.explode(F.array(*(F.lit(1 << i) for i in range(k)))).alias("block")).where(F.col("mask").bitwiseAND(F.col("block")) == 0)
        grown = more.groupBy("sample_id", F.col("mask").bitwiseOR(F.col("block")).alias("mask")).agg(F.count(F.lit(1)).alias("ways"))
        wanted = settled(grown.where(F.col("ways") == (size if always else size + 1)).select("sample_id", "mask"))
        if wanted.isEmpty():
            break
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(fits), union(models)


def model_order(models: DataFrame) -> DataFrame:
    """Models by number of blocks, then BIC, missing ones last."""
    w = Window.partitionBy("sample_id").orderBy("n_blocks", F.col("bic").asc_nulls_last(), "mask")
    return models.withColumn("place", F.row_number().over(w))


def best_models(models: DataFrame) -> DataFrame:
    """Each sample's model of lowest BIC."""
    return models.groupBy("sample_id").agg(F.min_by(F.struct("mask", "model", "n_blocks", "n_good", "n_bad", "rss", "median_error", "bic"), F.struct("bic", "n_blocks", "mask")).alias("m")).select("sample_id", "m.*")


def peak_statistics(fits: DataFrame, models: DataFrame, masses: Sequence[float], tolerance: float, own: DataFrame | None = None) -> DataFrame:
    """A2, A3: per peak the models tested and explaining, whether these agree on one composition (or there is none), and the simplest:
    fewest blocks, fewest copies, heaviest smallest block used, then model order. own: (sample_id, masses) where samples have masses of their own."""
    rows = of_models(fits, models, "n_blocks", "model")
    rows = rows.withColumn("masses", doubles(masses)) if own is None else rows.join(own, "sample_id")
    good = F.col("error") < tolerance
    used = F.filter(F.zip_with("composition", "masses", lambda n, m: F.when(n > 0, m)), lambda m: m.isNotNull())
    key = F.struct("n_blocks", total(F.col("composition")).alias("copies"), (-F.coalesce(F.array_min(used), F.lit(0.0))).alias("lightest"), "mask")
    return rows.groupBy("sample_id", "peak_id").agg(
        F.first("observed").alias("observed"), F.count(F.lit(1)).alias("n_tested"), F.count_if(good).alias("n_explaining"),
        F.coalesce(F.min(F.when(good, F.col("composition"))) == F.max(F.when(good, F.col("composition"))), F.lit(True)).alias("consistent"),
        F.min_by(F.struct("model", "composition", "mask"), F.when(good, key)).alias("best"),
    ).select("sample_id", "peak_id", "observed", "n_tested", "n_explaining", "consistent", F.col("best.model").alias("best_model"), F.col("best.composition").alias("best_composition"))


def explained_peaks(peaks: DataFrame, names: Sequence[str], masses: Sequence[float], limits: Sequence[int], common: float, tolerance: float) -> DataFrame:
    """A row for each peak with good, its fits of all subset models below the tolerance, and what ranks these: n_blocks, copies, lightest, model."""
    used = F.filter(F.zip_with("composition", doubles(masses), lambda n, m: F.when(n > 0, m)), lambda m: m.isNotNull())
    also = [F.col("n_blocks"), total(F.col("composition")).alias("copies"), (-F.coalesce(F.array_min(used), F.lit(0.0))).alias("lightest"), F.array_join("blocks", "+").alias("model")]
    return fits_within(peaks, masses, limits, common, subset_masks(peaks.sparkSession, names), tolerance, also)


#: Bits of a word, of several that hold a bit or more for each model.
WORD = 60


def perfect_words(good: Column, k: int) -> list[Column]:
    """Words with a bit for each of the models in good, WORD models a word. Their bit_and over a sample's peaks has its perfect models."""
    return packed_words(good, lambda f: F.lit(1), 1, k)


def packed_words(good: Column, value: Callable[[Column], Column], width: int, k: int) -> list[Column]:
    """Words with a value of `width` bits for each of the models in good, WORD // width models a word."""
    each, none = WORD // width, F.lit(0).cast("long")

    def word(w: int) -> Column:
        here = lambda f: F.when(F.floor(f["mask"] / each) == w, F.call_function("shiftleft", value(f).cast("long"), f["mask"] % each * width)).otherwise(none)
        return F.aggregate(good, none, lambda a, f: a.bitwiseOR(here(f)))

    return [word(w) for w in range((2**k - 1) // each + 1)]


def perfect_masks(words: Sequence[Column], k: int) -> Column:
    at = lambda m: F.call_function("getbit", F.get(F.array(*words), F.floor(m / WORD).cast("int")), m % WORD)
    none = reduce(lambda a, b: a & b, (w == 0 for w in words))
    return F.when(none, F.array().cast("array<int>")).otherwise(F.filter(all_masks(k), lambda m: at(m) == 1))


def all_masks(k: int) -> Column:
    return F.array(*map(F.lit, range(1, 2**k)))


def _supersets(mask: Column, perfect: Column) -> Column:
    return F.exists(perfect, lambda p: (p != mask) & (mask.bitwiseAND(p) == p))


def kept_masks(perfect: Column, k: int) -> Column:
    """without_supersets() in a row: the masks that contain no other perfect one."""
    return F.when(F.size(perfect) == 0, all_masks(k)).otherwise(F.filter(all_masks(k), lambda m: ~_supersets(m, perfect)))


def kept_fits(explained: DataFrame, k: int) -> DataFrame:
    """explained_peaks() less the models that contain a perfect one of their sample, and models, the masks that are left. Peaks that are dealt out and sorted by sample stay where they are;
    others are dealt out and sorted here, with their fits."""
    words = [f"__w{w}" for w in range((2**k - 1) // WORD + 1)]
    rows = explained.withColumns(dict(zip(words, perfect_words(F.col("good"), k))))
    rows = rows.withColumns({w: F.bit_and(w).over(Window.partitionBy("sample_id")) for w in words}).withColumn("__perfect", perfect_masks([F.col(w) for w in words], k))
    good = F.when(F.size("__perfect") == 0, F.col("good")).otherwise(F.filter("good", lambda f: ~_supersets(f["mask"], F.col("__perfect"))))
    return rows.withColumns({"good": good, "models": kept_masks(F.col("__perfect"), k)}).drop("__perfect", *words)


def kept_statistics(kept: DataFrame) -> DataFrame:
    """peak_statistics() of kept_fits(), row by row."""
    best = F.array_min(F.transform("good", lambda f: F.struct(f["n_blocks"], f["copies"], f["lightest"], f["mask"], f["model"].alias("model"), f["composition"].alias("composition"))))
    return kept.select(
        "sample_id", "peak_id", "observed", F.size("models").cast("long").alias("n_tested"), F.size("good").cast("long").alias("n_explaining"),
        (F.size(F.array_distinct(F.transform("good", lambda f: f["composition"]))) <= 1).alias("consistent"), best.alias("best"),
    ).select("sample_id", "peak_id", "observed", "n_tested", "n_explaining", "consistent", F.col("best.model").alias("best_model"), F.col("best.composition").alias("best_composition"))


def model_shares(peak_stats: DataFrame) -> DataFrame:
    """A4: of the explained peaks, how many and what percentage each best model has."""
    counts = peak_stats.where(F.col("best_model").isNotNull()).groupBy("sample_id", "best_model").agg(F.count(F.lit(1)).alias("n_peaks"))
    return counts.withColumn("percent", 100 * F.col("n_peaks") / F.sum("n_peaks").over(Window.partitionBy("sample_id")))


def simplest_prefix(fits: DataFrame, masks: DataFrame, tolerance: float) -> DataFrame:
    """The fewest blocks of a nested model that explain a peak; null if none does."""
    rows = fits.join(masks.select("mask", "n_blocks"), "mask")
    return rows.groupBy("sample_id", "peak_id").agg(F.min(F.when(F.col("error") < tolerance, F.col("n_blocks"))).alias("simplest"))
