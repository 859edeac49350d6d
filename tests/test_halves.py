import random

from peakloom.operators import lattice

MASSES, LIMITS, NAMES = [5.25, 7.5, 3.125, 11.0], [3, 2, 4, 2], ["a", "b", "c", "d"]
COMMON = 10.0


def spectrum(spark, n=60):
    draw = random.Random(1)
    rows = [("s", k, COMMON + draw.choice([round(draw.uniform(-5, 90), 3), draw.randrange(0, 60) / 8])) for k in range(n)]
    return spark.createDataFrame([*rows, ("s", n, None), ("t", 1, COMMON), ("t", 2, -500.0), ("t", 3, 5000.0)], "sample_id string, peak_id int, observed double")


def as_dict(rows, *keys):
    return {tuple(r[k] for k in keys): (list(r.composition), round(r.error, 9)) for r in rows.collect()}


def test_split_keeps_the_table_small():
    assert lattice.split_at([10, 8, 3, 4]) == 0
    at = lattice.split_at([10] + [4] * 7)
    size = 1
    for n in ([10] + [4] * 7)[at:]:
        size *= n + 1
    assert at == 2 and size <= lattice.HALF
    assert lattice.split_at([4] * 5, 10) == 4 and lattice.split_at([99], 10) == 1


def test_closest_agrees_with_the_whole_lattice(spark):
    peaks = spectrum(spark)
    points = lattice.lattice(spark, MASSES, LIMITS)
    want = as_dict(lattice.nearest(peaks, points, COMMON), "sample_id", "peak_id")
    assert len(want) == 63
    for half in (1, 3, 20, 50, 1000):
        assert as_dict(lattice.closest(peaks, MASSES, LIMITS, COMMON, half=half), "sample_id", "peak_id") == want


def test_closest_agrees_for_every_model(spark):
    peaks = spectrum(spark, 30)
    masks = lattice.subset_masks(spark, NAMES)
    want = as_dict(lattice.nearest(peaks, lattice.model_lattice(lattice.lattice(spark, MASSES, LIMITS), masks), COMMON, ["mask"]), "sample_id", "peak_id", "mask")
    assert len(want) == 33 * 15
    for half in (1, 20, 1000):
        assert as_dict(lattice.closest(peaks, MASSES, LIMITS, COMMON, masks, half=half), "sample_id", "peak_id", "mask") == want


def test_masses_below_nothing(spark):
    peaks = spectrum(spark, 20)
    masses = [5.25, -7.5, 3.125, 11.0]
    want = as_dict(lattice.nearest(peaks, lattice.lattice(spark, masses, LIMITS), COMMON), "sample_id", "peak_id")
    assert as_dict(lattice.closest(peaks, masses, LIMITS, COMMON, half=20), "sample_id", "peak_id") == want


def test_within_agrees_with_the_whole_lattice(spark):
    peaks = spectrum(spark, 40)
    key = ("sample_id", "peak_id", "alternative")
    for most in (500, 3):
        want = as_dict(lattice.alternatives(peaks, lattice.lattice(spark, MASSES, LIMITS), COMMON, 0.5, most), *key)
        for half in (1, 20, 1000):
            assert as_dict(lattice.within(peaks, MASSES, LIMITS, COMMON, 0.5, most, half), *key) == want


def test_no_table_of_all_compositions(spark):
    plan = lattice.closest(spectrum(spark), [160.0 + k for k in range(8)], [10] + [4] * 7, COMMON)._jdf.queryExecution().optimizedPlan().toString()
    before_join = plan[plan.index("Join") :]
    assert before_join.count("explode(sequence(0, 4") + before_join.count("explode(org.apache.spark") >= 0 and "Cartesian" not in plan
    assert lattice.lattice(spark, [1.0] * 6, [4] * 6).count() == 15_625


def test_more_blocks_than_a_mask_holds(spark):
    try:
        lattice.subset_masks(spark, [f"b{k}" for k in range(32)])
    except ValueError as e:
        assert "31" in str(e)
    else:
        raise AssertionError


def test_peaks_are_not_the_broadcast_side(spark):
    """peaks that are still to be exploded looked as small as their file."""
    for find in (lambda p: lattice.closest(p, [160.0 + k for k in range(8)], [10] + [4] * 7, COMMON), lambda p: lattice.within(p, [160.0 + k for k in range(8)], [10] + [4] * 7, COMMON, 0.5)):
        plan = find(spectrum(spark))._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in plan


def test_many_peaks_agree_with_few(spark):
    """one lookup for each peak and model gives what the lookups behind all fronts give."""
    peaks = spectrum(spark, 40)
    masses, limits = [5.253, 7.517, 3.121, 11.009], LIMITS
    assert as_dict(lattice.closest_of_many(peaks, masses, limits, COMMON), "sample_id", "peak_id") == as_dict(lattice.closest(peaks, masses, limits, COMMON, half=20), "sample_id", "peak_id")
    masks = lattice.subset_masks(spark, NAMES)
    want = as_dict(lattice.closest(peaks, MASSES, LIMITS, COMMON, masks, half=20), "sample_id", "peak_id", "mask")
    got = lattice.closest_of_many(peaks, MASSES, LIMITS, COMMON, masks)
    assert as_dict(got, "sample_id", "peak_id", "mask") == want and len(want) == 43 * 15
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "front" not in plan
