import random
import re

import pytest

from peakloom.operators import compare, lattice

NAMES, MASSES, LIMITS, COMMON = ("Hex", "b", "c", "d"), [50.0, 70.3, 91.7, 110.9], [6, 3, 2, 2], 10.0


@pytest.fixture(scope="module")
def peaks(spark):
    draw = random.Random(3)
    rows = [("one", k, COMMON + 50.0 * k) for k in range(5)]
    rows += [("two", k, COMMON + 50.0 * draw.randint(0, 5) + 70.3 * draw.randint(1, 3)) for k in range(6)]
    rows += [("none", k, COMMON + 400 + 13.7 * k) for k in range(6)]
    return spark.createDataFrame(rows, "sample_id string, peak_id int, observed double").cache()


@pytest.mark.parametrize("level", [1, 2])
def test_only_models_without_a_perfect_part_are_fitted(spark, peaks, level):
    masks = lattice.subset_masks(spark, NAMES, level)
    whole = compare.model_summary(lattice.closest(peaks, MASSES, LIMITS, COMMON, masks), masks, 0.01)
    want = compare.without_supersets(whole)
    fits, models = compare.level_search(peaks, NAMES, MASSES, LIMITS, COMMON, 0.01, level)
    as_rows = lambda df: sorted(str(r) for r in df.select(*sorted(whole.columns)).collect())
    assert as_rows(models) == as_rows(want)
    fitted = {(r.sample_id, r.mask) for r in fits.select("sample_id", "mask").distinct().collect()}
    assert fitted == {(r.sample_id, r.mask) for r in want.collect()}  # nothing else was fitted
    assert len(fitted) < whole.count()
    per_sample = {s: sum(x == s for x, _ in fitted) for s in ("one", "two", "none")}
    assert per_sample["none"] == masks.count() and per_sample["one"] == (1 if level == 1 else 8)


def test_wanted_models_with_blocks_in_front(spark, peaks):
    masks = lattice.subset_masks(spark, NAMES)
    wanted = spark.createDataFrame([("one", 1), ("one", 15), ("two", 3), ("none", 12), ("nobody", 1)], "sample_id string, mask int")
    whole = lattice.closest(peaks, MASSES, LIMITS, COMMON, masks).join(wanted, ["sample_id", "mask"], "left_semi")
    key = lambda df: sorted((r.sample_id, r.peak_id, r.mask, r.composition) for r in df.collect())
    for half in (1, 12, 10_000):
        assert key(lattice.closest(peaks, MASSES, LIMITS, COMMON, masks, half, wanted)) == key(whole)


def test_models_of_equal_errors_tie_in_any_order(spark):
    """squares used to be added as rows came, and noise in the last bits ordered models of equal BIC."""
    draw = random.Random(5)
    errors = [draw.uniform(0, 9) for _ in range(40)]
    rows = [("s", mask, k, e) for mask in (3, 5, 6) for k, e in enumerate(draw.sample(errors, len(errors)))]
    fits = spark.createDataFrame(rows, "sample_id string, mask int, peak_id int, error double").repartition(7)
    masks = lattice.subset_masks(spark, NAMES)
    models = compare.model_summary(fits, masks, 2.0)
    assert len({(r.rss, r.median_error, r.bic) for r in models.collect()}) == 1
    assert [r["mask"] for r in compare.model_order(models).orderBy("place").collect()] == [3, 5, 6]
    whole, parts = models.collect(), compare.model_summary(fits, masks, 2.0, large=10).collect()
    assert [(r.n, r.n_good, r.n_bad, round(r.rss, 9), round(r.median_error, 12)) for r in whole] == [(r.n, r.n_good, r.n_bad, round(r.rss, 9), round(r.median_error, 12)) for r in parts]


def test_models_take_one_shuffle_of_peaks(spark):
    """F6 and others: peaks dealt out by sample stay where they are, through fits, models and statistics."""
    rows = [("s", k, COMMON + 50.0 * k) for k in range(9)] + [("t", k, COMMON + 31.7 * k) for k in range(9)]
    peaks = spark.createDataFrame(rows, "sample_id string, peak_id int, observed double").repartition("sample_id")
    masks = lattice.subset_masks(spark, NAMES)
    fits = lattice.closest(peaks, MASSES, LIMITS, COMMON, masks)
    models = compare.without_supersets(compare.model_summary(fits, masks, 0.01))
    stats = compare.peak_statistics(fits, models, MASSES, 0.01)
    stats.write.format("noop").mode("overwrite").save()
    plan = stats._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert "hashpartitioning(sample_id" in initial and "Exchange hashpartitioning(peak_id" not in initial
    assert not re.search(r"Exchange hashpartitioning\(sample_id#\d+L?, (peak_id|mask)", initial)
    assert stats.count() == 18
