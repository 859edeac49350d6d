import itertools
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from peakloom.operators import fit
from tests.spectrum import COMMON, MASSES, PEAKS


def test_trials_are_many_tasks(spark):
    """few bytes, much work: Spark must not join the trials into one task."""
    rows = spark.createDataFrame([(s, 0, PEAKS[:6], list(MASSES[:2]), 2, COMMON) for s in range(16)], "sample_id int, trial int, observed array<double>, start array<double>, n_known int, start_common double")
    tasks = fit.run_trials(rows, fit.FitConfig(), iterations=1).select(F.spark_partition_id().alias("p")).distinct()
    assert tasks.count() > 4
    models = rows.select("sample_id", F.lit(3).alias("mask"), "observed", F.col("start").alias("masses"), F.col("start_common").alias("common"))
    assert fit.fit_models(models, lambda k: [3] * k).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert fit.sample_alternatives(models.drop("mask"), lambda k: [3] * k, 0.5).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_connectivity_counts_equal_compositions():
    rng = np.random.default_rng(5)
    for k in (1, 2, 4):
        x, good = rng.integers(0, 3, size=(60, k)), rng.random(60) < 0.8
        steps = Counter()
        for a, b in itertools.combinations(map(tuple, x[good].tolist()), 2):
            d = tuple(q - p for p, q in zip(a, b))
            if sum(map(abs, d)) in (1, 2):
                steps[max(d, tuple(-v for v in d))] += 1
        assert fit.connectivity(x, good) == sum(n * n for n in steps.values())
    assert fit.connectivity(np.zeros((3, 2), dtype=int), np.zeros(3, dtype=bool)) == fit.connectivity(np.zeros((3, 0), dtype=int), np.ones(3, dtype=bool)) == 0
    began = time.perf_counter()
    fit.connectivity(rng.integers(0, 4, size=(20_000, 4)), np.ones(20_000, dtype=bool))
    assert time.perf_counter() - began < 5  # 200 million pairs


def test_the_sorted_lattice_and_its_halves_agree():
    rng = np.random.default_rng(6)
    for masses in ([100.0, 200.0, 50.0], [162.052824, 203.079374, 146.05791, 81.026412], [37.0]):
        y = np.concatenate([rng.uniform(-100, 2500, 200), np.arange(0, 1000, 25.0), [1e9, -1e9]])
        limits = [3, 4, 2, 5][: len(masses)]
        got = fit.nearest_compositions(y, np.array(masses), limits)
        assert np.array_equal(got, fit._nearest_by_halves(y, np.array(masses), limits))


def test_known_blocks_are_placed_in_long_spectra():
    b, n = np.array([100.0, 1.0]), 8000
    y = np.full(n, 200.0)
    began = time.perf_counter()
    x = fit._use_all_known(np.tile([2, 0], (n, 1)), y, b, [4, 4], 2, 0.3, 1e3)
    assert x.any(axis=0).all() and (x[:, 1] > 0).sum() == 1 and time.perf_counter() - began < 10
