import random

import pytest
from pyspark.sql import functions as F

from peakloom.operators import candidates
from peakloom.sinks import tables
from peakloom.sources import dictionary
from tests.spectrum import COMMON, MASSES, peaks


@pytest.fixture(scope="module")
def found(spark):
    ranked, rejected = candidates.discover(peaks(spark, "a", "b"), dictionary.blocks(spark), COMMON, MASSES[:1])
    return ranked.cache(), rejected.cache()


def test_pairs_and_reasons(spark, found):
    assert candidates.pair_differences(peaks(spark), COMMON, 40.0).count() == 457
    assert candidates.pair_differences(peaks(spark), COMMON, 0.0).count() == 496
    kinds = dict(tuple(r) for r in found[1].where("sample_id = 'a'").groupBy(F.regexp_extract("reason", r"^(Too|Mult|Comb|Diff|Below|Above)", 1).alias("k")).count().collect())
    assert kinds == {"Too": 20, "Mult": 14, "Comb": 166, "Diff": 99, "Above": 9}


def test_ranking(found):
    rows = found[0].where("sample_id = 'b'").orderBy("rank").collect()
    assert len(rows) == 36 and sum(r["size"] for r in rows) == 149
    # Golden values, derived.
    want = [(203.0794, 135401.227, 14, "HexNAc"), (146.0579, 116779.991, 12, "dHex"), (291.0954, 87707.698, 9, "NeuAc"), (250.0688, 74234.324, 8, "KDN"), (187.0845, 74130.469, 8, "dHexNAc"), (79.9996, 50000.0, 5, "PhSu"), (307.0903, 46685.004, 5, "NeuGc"), (121.0262, 9374.424, 10, None)]
    for r, (median, score, size, name) in zip(rows, want):
        assert (round(r["median"], 4), r["size"], r["name"]) == (median, size, name)
        assert r["score"] == pytest.approx(score, rel=1e-5)
        assert r["values"] == sorted(r["values"]) and len(r["values"]) == min(5, size)


def test_exclusion_and_availability(spark, found):
    medians = lambda df: [round(r["median"], 3) for r in df.where("sample_id = 'a'").orderBy("rank").collect()]
    every = medians(found[0])
    left = medians(candidates.without_excluded(found[0], [203.079374], MASSES[:1], [121.0]))
    gone = [x for x in every if x not in left]
    near = lambda x, m: abs(x - m) < 0.5
    sums = [203.079374 * k for k in range(1, 6)] + [a * MASSES[0] + b * 203.079374 for a in range(4) for b in range(4) if a + b]
    assert gone == [x for x in every if any(near(x, s) for s in sums) and not near(x, 121.0)] and 203.079 in gone
    assert medians(candidates.without_excluded(found[0], [])) == every
    assert medians(candidates.available(found[0], [203.079374, 250.07])) == [x for x in every if not near(x, 203.079374) and not near(x, 250.07)][:5]


def test_report_layout(found):
    rows = tables.candidates_file(*found).where("sample_id = 'a'").collect()
    assert {r.Status for r in rows} == {"ACTIVE", "FILTERED"} and len(rows) == 36 + 308
    first = next(r for r in rows if r.Median.startswith("203.079"))
    assert first.Sample_Values.count(",") == 4 and first.Sample_Values.endswith("...(9 more)")


def test_names_go_by_order_not_distance(spark):
    book = spark.createDataFrame([(0, "far", 100.4, "mod"), (1, "close", 100.0, "rare")], "ord int, name string, mass double, category string")
    rows = spark.createDataFrame([(100.0,), (99.7,), (100.9,), (50.0,)], "mass double")
    got = {r.mass: (r["name"], r.category) for r in candidates.named_by_mass(rows, book).collect()}
    assert got == {100.0: ("far", "mod"), 99.7: ("close", "rare"), 100.9: (None, "unknown"), 50.0: (None, "unknown")}


def test_resolved_masses(spark):
    rows = spark.createDataFrame([("hex",), (" 12.5 ",), ("nope",)], "token string")
    got = {r.token: r.mass for r in candidates.resolved_masses(rows, dictionary.blocks(spark)).collect()}
    assert got == {"hex": MASSES[0], " 12.5 ": 12.5, "nope": None}


def test_no_candidates(spark):
    ranked, rejected = candidates.discover(peaks(spark).where("peak_id < 2"), dictionary.blocks(spark), COMMON, ())
    assert ranked.count() == rejected.count() == 0


def test_differences_within_a_bound(spark):
    draw = random.Random(9)
    rows = [(s, k, round(draw.uniform(0, 3000), draw.choice([0, 3]))) for s in ("a", "b") for k in range(80)] + [("c", 1, 0.0), ("c", 2, 370.0), ("c", 3, 740.0), ("c", 4, -370.0)]
    peaks = spark.createDataFrame(rows, "sample_id string, peak_id int, observed double")
    every = candidates.pair_differences(peaks, 10.0, 40.0)
    for most in (370.0, 41.5, 5000.0):
        near = candidates.pair_differences(peaks, 10.0, 40.0, most)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, every.where(f"diff <= {most}").collect()))
