import math

import numpy as np
import pytest

from peakloom.operators import diagnostics
from tests import shapiro

VALUES = [(100.0 + 7 * k, 100.0 + 7 * k - v) for k, v in enumerate([1.0, 2.0, 4.0, 9.0, 0.5, -3.0, 2.5])]


def stats(spark, rows):
    return diagnostics.residual_statistics(spark.createDataFrame([("s", *r) for r in rows], "model string, observed double, reconstructed double"), ["model"]).first()


def test_moments_and_line(spark):
    r = stats(spark, VALUES)
    x, e = np.array([a for a, _ in VALUES]), np.array([a - b for a, b in VALUES])
    n, m, s = len(e), e.mean(), e.std(ddof=1)
    assert (r.mean, r.median, r.std, r.low, r.high) == pytest.approx((m, np.median(e), s, e.min(), e.max()))
    assert r.skewness == pytest.approx(((e - m) ** 3).mean() / s**3) and r.kurtosis == pytest.approx(((e - m) ** 4).mean() / s**4 - 3)
    slope, intercept = np.polyfit(x, e, 1)
    left = ((e - slope * x - intercept) ** 2).sum()
    t = abs(slope) / math.sqrt(left / (n - 2) / ((x - x.mean()) ** 2).sum())
    assert (r.slope, r.intercept) == pytest.approx((slope, intercept)) and r.line_r2 == pytest.approx(1 - left / ((e - m) ** 2).sum()) and r.biased == (t > 2)
    assert (r.ppm_mean, r.ppm_max) == pytest.approx(((abs(e) / x * 1e6).mean(), (abs(e) / x * 1e6).max()))
    assert r.r2 == pytest.approx(1 - (e**2).sum() / ((x - x.mean()) ** 2).sum())


def test_few_or_equal_values(spark):
    r = stats(spark, VALUES[:1])
    assert (r.std, r.skewness, r.kurtosis, r.slope, r.intercept, r.line_r2, r.biased, r.r2) == (0, 0, 0, 0, 1.0, 0, False, 0)
    r = stats(spark, [(10.0, 9.0)] * 5)
    assert (r.std, r.skewness, r.kurtosis, r.slope, r.intercept, r.r2) == (0, 0, 0, 0, 1.0, 0)
    r = stats(spark, [(10.0, 9.0), (20.0, 19.0), (30.0, 29.0), (40.0, 39.0)])
    assert (r.slope, r.line_r2, r.biased) == (0, 0, False)
    r = stats(spark, [(-10.0, -9.0), (20.0, 17.0), (30.0, 29.0)])
    assert r.ppm_mean == pytest.approx((0 + 3 / 20e-6 + 1 / 30e-6) / 3)


def test_shapiro_wilk(spark):
    # Published examples, W and p.
    w, p = shapiro.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.0005)
    rng = np.random.default_rng(0)
    normal = [shapiro.shapiro_wilk(rng.normal(size=n))[1] for n in (4, 5, 6, 10, 12, 30, 200) for _ in range(60)]
    assert 0.01 < np.mean(np.array(normal) < 0.05) < 0.1
    assert all(shapiro.shapiro_wilk(rng.exponential(size=200))[1] < 1e-6 for _ in range(5))
    assert shapiro.shapiro_wilk(np.array([1.0, 2.0])) == (None, None) == shapiro.shapiro_wilk(np.ones(9))
    assert shapiro.shapiro_wilk(np.array([1.0, 2.0, 3.0])) == pytest.approx((1.0, 1.0), abs=1e-6)
    rows = spark.createDataFrame([("a", float(k % 7), 0.0) for k in range(40)] + [("b", 1.0, 0.0)], "model string, observed double, reconstructed double")
    got = {r.model: r for r in diagnostics.normality(rows, ["model"]).collect()}
    assert 0 < got["a"].p < 1 and got["a"].normality_ok is not None
    assert {r.model: r.w for r in diagnostics.normality(rows, ["model"], most=10).collect()}["a"] is None


def test_usage(spark):
    rows = [("m", k, [k % 3, 1 if k < 2 else 0, 0]) for k in range(8)]
    facts = spark.createDataFrame(rows, "model string, peak_id int, composition array<int>")
    blocks = spark.createDataFrame([("A", 10.0, "discovered")], "name string, value double, type string")
    got = {r.block: r for r in diagnostics.usage_by_block(facts, ["model"], ["A", "B", "C"], blocks).collect()}
    assert (got["A"].n_used, got["A"].mean_copies, got["A"].max_copies, got["A"].flagged, got["A"].type, got["A"].mass) == (5, pytest.approx(7 / 5), 2, False, "discovered", 10.0)
    assert (got["B"].n_used, got["B"].flagged, got["B"].type) == (2, True, "known") and (got["C"].n_used, got["C"].mean_copies) == (0, 0.0)
    per = diagnostics.blocks_per_peak(facts, ["model"]).first()
    assert (per.mean_blocks, per.max_blocks, per.common_only) == (7 / 8, 2, 2)
    assert [(r.block_a, r.block_b, r.n_peaks) for r in diagnostics.cooccurrence(facts, ["model"], ["A", "B", "C"]).collect()] == [("A", "B", 1)]
    labelled = spark.createDataFrame([("A+B", [1, 0, 0]), ("Consensus", [0, 0, 4])], "model string, composition array<int>")
    assert {r.model: r.blocks for r in diagnostics.model_blocks(labelled, ["A", "B", "C"]).collect()} == {"A+B": ["A", "B"], "Consensus": ["C"]}


def test_normality_of_any_size(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{n}": rng.normal(5, 2, size=n).round(2) for n in (2, 3, 4, 5, 6, 11, 12, 400, 7000)} | {"skewed": rng.exponential(size=7000), "equal": np.ones(9)}
    rows = [(g, float(v), 1.0) for g, values in groups.items() for v in values] + [("g12", None, 1.0), ("g12", float("nan"), 1.0)]
    got = {r.model: r for r in diagnostics.normality(spark.createDataFrame(rows, "model string, observed double, reconstructed double"), ["model"]).collect()}
    for g, values in groups.items():
        w, p = shapiro.shapiro_wilk(values - 1)
        assert (got[g].w, got[g].p) == ((None, None) if w is None else pytest.approx((w, p), abs=1e-7)), g
        assert got[g].beyond_fit == (len(values) > 5000)
    assert got["skewed"].normality_ok is False
