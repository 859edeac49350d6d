import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import compare, consensus, dependencies, fit, lattice
from tests.spectrum import COMMON, MASSES, NAMES, PEAKS, peaks

# Golden values, derived: model, good, rss, BIC.
MODELS = """\
Hex 5 54924.61029 241.8011
HexNAc 2 105899.08846 262.8099
dHex 2 71611.15492 250.2904
NeuAc 0 229423.33994 287.5486
Hex+HexNAc 13 2832.15769 150.3893
Hex+dHex 8 10713.29380 192.9636
Hex+NeuAc 5 13645.06097 200.7042
HexNAc+dHex 7 4715.71093 166.7049
HexNAc+NeuAc 3 18017.91267 209.5998
dHex+NeuAc 3 68226.64183 252.2068
Hex+HexNAc+dHex 22 8.79285 -30.9403
Hex+HexNAc+NeuAc 19 2024.48598 143.1119
Hex+dHex+NeuAc 9 9996.57404 194.2136
HexNAc+dHex+NeuAc 10 4297.55414 167.1993
Hex+HexNAc+dHex+NeuAc 32 0.26073 -140.0567
"""


@pytest.fixture(scope="module")
def compared(spark):
    masks = lattice.subset_masks(spark, NAMES)
    points = lattice.lattice(spark, MASSES, [10] * 4, max(PEAKS) - COMMON + 400)
    fits = lattice.nearest(peaks(spark, "a", "b"), lattice.model_lattice(points, masks), COMMON, ["mask"]).cache()
    return points, masks, fits, compare.model_summary(fits, masks, 0.5).cache()


def test_subset_models(compared):
    rows = {r.model: r for r in compared[3].where("sample_id = 'a'").collect()}
    assert len(rows) == 15
    for line in MODELS.splitlines():
        name, good, rss, bic = line.split()
        r = rows[name]
        assert (r.n_good, r.n_bad) == (int(good), 32 - int(good))
        assert r.rss == pytest.approx(float(rss), abs=2e-5) and r.bic == pytest.approx(float(bic), abs=1e-3)
    assert rows["Hex+HexNAc+dHex+NeuAc"].median_error == pytest.approx(0.09232, abs=1e-5)
    assert compare.best_models(compared[3]).where("sample_id = 'b'").first().model == "Hex+HexNAc+dHex+NeuAc"


def test_levels_and_prefixes(spark):
    assert lattice.subset_masks(spark, NAMES, 1).count() == 8
    assert lattice.subset_masks(spark, ["x", "y"], 1).count() == 3
    assert [r.mask for r in lattice.prefix_masks(spark, NAMES, 2).orderBy("mask").collect()] == [3, 7, 15]


def test_alternatives(spark, compared):
    rows = lattice.alternatives(peaks(spark), compared[0], COMMON, 0.5).cache()
    assert rows.count() == 35 and rows.agg(F.max("alternative")).first()[0] == 2
    some = {r.observed: r.composition for r in rows.where("alternative = 1").collect()}
    assert some[1352.555] == [2, 0, 0, 0] and some[1434.6082] == [0, 2, 0, 0] and some[1539.6395] == [1, 1, 1, 0]
    none = lattice.alternatives(spark.createDataFrame([("s", 1, 5.0)], "sample_id string, peak_id int, observed double"), compared[0], COMMON, 0.5).first()
    assert (none.alternative, none.composition, none.error) == (1, [0, 0, 0, 0], math.inf)
    summary = lattice.ambiguity_summary(lattice.ambiguity(rows)).first()
    assert summary.n_clear + summary.n_ambiguous == 3


def test_supersets_and_peaks(spark, compared):
    _, _, fits, models = compared
    wide = models.withColumn("n_bad", F.when(F.col("model") == "Hex+HexNAc+dHex", 0).otherwise(F.col("n_bad")))
    left = {r.model for r in compare.without_supersets(wide).collect()}
    assert len(left) == 14 and "Hex+HexNAc+dHex+NeuAc" not in left
    stats = compare.peak_statistics(fits, models, MASSES, 0.5).where("sample_id = 'a'").cache()
    for r in stats.collect():
        own = [(m.n_blocks, sum(f.composition), -min([x for x, c in zip(MASSES, f.composition) if c], default=0), m.mask, m.model, f.composition) for f in fits.where((F.col("peak_id") == r.peak_id) & (F.col("sample_id") == "a") & (F.col("error") < 0.5)).collect() for m in models.where((F.col("mask") == f.mask) & (F.col("sample_id") == "a")).collect()] if r.peak_id in (1, 6, 20) else None
        if own:
            best = min(own)
            assert (r.best_model, r.best_composition, r.n_explaining, r.n_tested) == (best[4], best[5], len(own), 15)
            assert r.consistent == (len({tuple(o[5]) for o in own}) <= 1)
    shares = compare.model_shares(stats).collect()
    assert sum(r.n_peaks for r in shares) == 32 and sum(r.percent for r in shares) == pytest.approx(100)


def test_dependencies(spark, compared):
    _, _, fits, _ = compared
    used = dependencies.block_usage_across_models(fits, 4, 0.5)
    got = {r.block: (r.n_used, r.n_with, r.prerequisites) for r in used.where("sample_id = 'a'").collect()}
    assert got == {0: (8, 8, 0), 1: (8, 8, 0), 2: (8, 8, 0), 3: (6, 8, 0)}
    hand = [("chain", b, 1, 1, 0, p) for b, p in enumerate([0, 1, 3])] + [("cycle", b, 1, 1, 0, p) for b, p in enumerate([2, 1, 3])]
    rows = spark.createDataFrame(hand, "sample_id string, block int, n_with int, n_used int, n_not_used int, prerequisites int")
    direct = dependencies.direct_dependencies(rows).cache()
    assert {(r.sample_id, r.block): r.direct for r in direct.collect()} == {("chain", 0): 0, ("chain", 1): 1, ("chain", 2): 2, ("cycle", 0): 2, ("cycle", 1): 1, ("cycle", 2): 0}
    assert {r.sample_id: r.ordering for r in dependencies.block_orders(direct).collect()} == {"chain": [0, 1, 2], "cycle": [2, 0, 1]}
    report = [r.asDict() for r in dependencies.dependency_report(direct, ["A", "B", "C"]).where("sample_id = 'chain'").orderBy("biosynthetic_order").collect()]
    assert [(r["block"], r["prerequisites"], r["direct_dependencies"]) for r in report] == [("A", "(none)", "(root)"), ("B", "A", "A"), ("C", "A+B", "B")]
    assert dependencies.tree_lines(report) == ["└── A", "    └── B", "        └── C"]
    assert dependencies.dependency_edges(direct, ["A", "B", "C"]).where("sample_id = 'chain'").count() == 2


def test_nearest_compositions_against_all():
    draw = random.Random(1)
    for _ in range(30):
        k = draw.randint(1, 4)
        masses, limits = np.array([draw.uniform(30, 300) for _ in range(k)]), [draw.randint(0, 4) for _ in range(k)]
        y = np.array([draw.uniform(-50, 1500) for _ in range(5)])
        every = list(itertools.product(*[range(m + 1) for m in limits]))
        got = fit.nearest_compositions(y, masses, limits)
        for t, c in zip(y, got.tolist()):
            assert abs(t - np.dot(c, masses)) == pytest.approx(min(abs(t - np.dot(e, masses)) for e in every))
            found = fit.within_tolerance(t, masses, limits, 40.0)
            assert sorted(f[0] for f in found) == sorted(list(e) for e in every if abs(t - np.dot(e, masses)) < 40.0)


def test_best_compositions_against_all():
    draw = random.Random(2)
    config = fit.FitConfig(max_known=2, max_unknown=2)
    for _ in range(25):
        b, n = np.array([draw.uniform(50, 200) for _ in range(3)]), draw.randint(2, 3)
        y = np.array([draw.uniform(0, 500) for _ in range(n)])

        def cost(x):
            e = np.abs(x @ b - y)
            return (e**2).sum() + 1e3 * np.maximum(0, e - config.tolerance).sum() + 10 * x[:, 2].any()

        cells = [np.array(c) for c in itertools.product(range(3), repeat=3)]
        least = min(cost(x) for rows in itertools.product(cells, repeat=n) if (x := np.array(rows))[:, 0].any() and x[:, 1].any())
        x = fit.best_compositions(y, b, 2, config, 1e3)
        assert x[:, 0].any() and x[:, 1].any() and cost(x) == pytest.approx(least)


def test_refit_is_the_minimum():
    rng = np.random.default_rng(3)
    config = fit.FitConfig()
    x, b = rng.integers(0, 4, size=(20, 3)), np.array([162.0, 203.0, 146.0])
    y = x @ np.array([162.05, 203.08, 146.06]) + rng.normal(0, 0.05, 20)
    got = fit.refit_masses(x, y, b, 2, b[:2], config)
    w = np.minimum(1, 0.5 / (np.abs(x @ b - y) + 1e-9))
    goal = np.array([162.0, 203.0, np.rint(146.0 / 1.00035) * 1.00035])
    value = lambda v: (w * (x @ v - y) ** 2).sum() + ((v - goal) ** 2 * [2e4, 2e4, 1e4]).sum()
    for _ in range(300):
        other = got + rng.normal(0, 0.01, 3)
        other[:2] = np.clip(other[:2], b[:2] - 0.05, b[:2] + 0.05)
        assert value(got) <= value(other) + 1e-9


def test_phase():
    out = fit.run_phase(np.array(PEAKS), np.array(MASSES), 2, COMMON, fit.FitConfig())
    assert out["n_good"] == 32 and all(out["used"]) and out["connectivity"] > 0
    base = fit.run_phase(np.array(PEAKS), np.zeros(0), 0, COMMON, fit.FitConfig())
    assert base["n_good"] == 0 and base["rss"] == pytest.approx(sum((p - COMMON) ** 2 for p in PEAKS))


def brute_connectivity(rows, peak, comp):
    return sum(any(sum(abs(a - b) for a, b in zip(comp, c)) == 1 for c in cs) for p, cs in rows.items() if p != peak)


def test_network_consensus(spark, compared):
    _, _, fits, _ = compared
    cands = consensus.explaining_compositions(fits.where("sample_id = 'a'"), 2.0).cache()
    rows = {}
    for r in cands.collect():
        rows.setdefault(r.peak_id, {})[tuple(r.composition)] = (r.error, r["mask"])
    got = {r.peak_id: tuple(r.composition) for r in consensus.network_consensus(peaks(spark, "a"), cands, 4).collect()}
    for p, cs in rows.items():
        best = max(cs, key=lambda c: (brute_connectivity(rows, p, c), -sum(c), -cs[c][0], -cs[c][1]))
        assert got[p] == best


def score(chosen, errors, tolerance):
    freq = {}
    for a, b in itertools.combinations(chosen, 2):
        d = tuple(y - x for x, y in zip(a, b))
        if 1 <= sum(map(abs, d)) <= 2:
            s = max(d, tuple(-v for v in d))
            freq[s] = freq.get(s, 0) + 1
    return sum(f * f for f in freq.values()) + 0.1 * sum(1 - e / tolerance if e < tolerance else -1 for e in errors)


def test_annealing_finds_the_best_choice():
    comps = [np.array(c) for c in ([[0, 0], [5, 5]], [[1, 0], [9, 9]], [[7, 7], [2, 0]], [[0, 3]], [[3, 0], [8, 1]])]
    errors = [np.array([0.1] * len(c)) for c in comps]
    best = max(itertools.product(*[range(len(c)) for c in comps]), key=lambda s: score([tuple(c[k]) for c, k in zip(comps, s)], [0.1] * 5, 0.5))
    got = consensus.Annealer(comps, errors, [np.zeros(len(c)) for c in comps], 0.5).run()
    assert tuple(got.tolist()) == best


def test_annealed_consensus_and_pruning(spark, compared):
    points, _, fits, _ = compared
    alts = lattice.alternatives(peaks(spark, "a", "b"), points, COMMON, 0.5).cache()
    got = {(r.sample_id, r.peak_id): r.composition for r in consensus.annealed_consensus(alts, 0.5).collect()}
    assert len(got) == 64 and got["a", 1] == got["b", 1] == [2, 0, 0, 0]
    usage = spark.createDataFrame([("a", b, 2, 2, 0, 1 if b == 2 else 0) for b in range(4)], "sample_id string, block int, n_with int, n_used int, n_not_used int, prerequisites int")
    scored = consensus.with_dependencies(alts, usage)
    for r in scored.where("error < 1").collect():
        assert r.dep_score == ((1 if r.composition[0] else -1) if r.sample_id == "a" and r.composition[2] else 0)
    pruned = consensus.with_dependencies(alts, usage, hard_prune=True).where("sample_id = 'a'").collect()
    assert {r.peak_id for r in pruned} == set(range(1, 33)) and all(not r.composition[2] or r.composition[0] for r in pruned)
    assert consensus.annealed_consensus(scored, 0.5, 0.3).count() == 64


def test_a_peak_far_beyond_the_lattice(spark):
    limits = [10, 8, 3, 4]
    points = lattice.lattice(spark, MASSES, limits)
    rows = spark.createDataFrame([("a", 1, 1e12), ("a", 2, COMMON + 162.052824), ("a", 3, -1e15), ("a", 4, None)], "sample_id string, peak_id int, observed double")
    got = {r.peak_id: (r.composition, r.error) for r in lattice.nearest(rows, points, COMMON).collect()}
    heaviest = sum(m * n for m, n in zip(MASSES, limits))
    assert got[1] == (limits, pytest.approx(1e12 - COMMON - heaviest)) and got[2][0] == [1, 0, 0, 0] and got[3][0] == [0, 0, 0, 0] and len(got) == 3
