import pytest
from pyspark.sql import functions as F

from peakloom.functions import exprs

NAMES = ["Hex", "HexNAc", "dHex"]


def one(spark, column, **values):
    kinds = {list: "array<int>", str: "string", float: "double", int: "int"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize("mode,matrix,want", [("neg_h", "nr", 1028.357059), ("neg_h", "r", 1026.341379), ("pos_na", "nr", 1052.354668), ("pos_na", "r", 1050.338988), ("pos_h", "nr", 1030.372739), ("pos_h", "r", 1028.357059)])
def test_common_mass(mode, matrix, want):
    masses = {"Hex": 162.052824, "HexNAc": 203.079374}
    assert exprs.common_mass({"Hex": 3, "HexNAc": 2, "Other": 4}, masses, 137.047679, mode, matrix) == pytest.approx(want, abs=1e-9)
    assert exprs.common_mass({}, masses) == 0


@pytest.mark.parametrize("delta,kind,penalty", [([0, 0], "identity", 2), ([1, 0], "clean", 0), ([-1, 0], "clean", 0), ([2, 0], "skip", 1), ([1, 1], "multi", 1), ([1, -1], "mixed", 4), ([0, -3], "skip", 2), ([-2, -2], "multi", 3)])
def test_transitions(spark, delta, kind, penalty):
    assert one(spark, exprs.transition_kind(F.col("d")), d=delta) == kind
    assert one(spark, exprs.transition_penalty(F.col("d")), d=delta) == penalty


def test_labels(spark):
    names = exprs.strings(NAMES)
    assert one(spark, exprs.composition_name(names, F.col("c")), c=[3, 2, 0]) == "3Hex+2HexNAc"
    assert one(spark, exprs.composition_name(names, F.col("c")), c=[0, 0, 0]) == "Common"
    assert one(spark, exprs.formula("Common", names, F.col("c")), c=[2, 0, 1]) == "Common + 2Hex + 1dHex"
    structure = lambda c: one(spark, exprs.merged_structure({"HexNAc": 2, "Pent": 1, "Hex": 3}, NAMES, F.col("c")), c=c)
    assert structure([2, 0, 1]) == "5Hex + 2HexNAc + 1dHex + 1Pent"
    assert one(spark, exprs.merged_structure({}, NAMES, F.col("c")), c=[0, 0, 0]) == "(core only)"
    assert one(spark, exprs.merged_structure({}, NAMES, F.lit(None).cast("array<int>"))) is None
    assert one(spark, exprs.delta_label(names, F.col("c")), c=[2, 0, -1]) == "+2Hex -dHex"
    assert one(spark, exprs.delta_label(names, F.col("c")), c=[0, 0, 0]) == "±0"
    assert one(spark, exprs.addition_label(names, F.col("c")), c=[-2, 0, -1]) == "+2Hex +dHex"
    assert one(spark, exprs.addition_label(names, F.col("c")), c=[-2, 0, 1]) == "-2Hex +dHex"
    assert one(spark, exprs.composition_label(names, F.col("c")), c=[3, 0, 1]) == "Hex×3 dHex×1"
    assert one(spark, exprs.composition_label(names, F.col("c")), c=[0, 0, 0]) == "(empty)"


def test_rounding_and_counts(spark):
    assert one(spark, exprs.nearest_multiple(F.col("v"), 1.0), v=2.5) == 2.0
    assert one(spark, exprs.nearest_multiple(F.col("v"), 1.0), v=3.5) == 4.0
    assert one(spark, exprs.multiple_distance(F.col("v"), 1.0), v=2.25) == 0.25
    counts = {"3": 3, "3.9": 3, "": 0, "x": 0, " 2 ": 2, "-1": -1}
    assert {k: one(spark, exprs.block_count(F.col("v")), v=k) for k in counts} == counts
    assert one(spark, exprs.is_multiple(F.col("v"), F.lit(3.0), 0.2), v=9.1)
    assert not one(spark, exprs.is_multiple(F.col("v"), F.lit(3.0), 0.2), v=0.1)


def test_steps_and_masks(spark):
    step = lambda a, b: one(spark, exprs.canonical_step(F.col("a"), F.col("b")), a=a, b=b)
    assert step([1, 0], [0, 0]) == [1, 0] and step([0, 0], [1, 0]) == [1, 0]
    assert step([0, 1], [1, 0]) == [1, -1] and step([0, 0], [0, 0]) is None and step([3, 0], [0, 0]) is None
    assert one(spark, exprs.masked(F.col("c"), exprs.strings(["dHex"]), exprs.strings(NAMES)), c=[1, 2, 3]) == [0, 0, 3]
    assert one(spark, exprs.block_bits(F.col("c")), c=[1, 0, 3]) == 5


def test_reordered_label(spark):
    order = exprs.strings(["Hex", "HexNAc", "dHex"])
    label = lambda x: one(spark, exprs.reordered_label(F.col("x"), order), x=x)
    assert label("Hex+dHex+HexNAc") == "Hex+HexNAc+dHex"
    assert label("dHex+New+Hex") == "Hex+dHex+New"
    assert label("BioConsensus2") == "BioConsensus2"


def test_bic(spark):
    assert one(spark, exprs.bic(F.lit(32), F.lit(0.26073), F.lit(4))) == pytest.approx(-140.0567, abs=2e-3)
    assert one(spark, exprs.adjusted_bic(F.lit(float("inf")), F.lit(3), exprs.doubles([50.0]))) == float("inf")
    assert one(spark, exprs.adjusted_bic(F.lit(1.0), F.lit(3), exprs.doubles([300.0, 150.0]))) == pytest.approx(1 + 6 * 0.6931471805599453)
    assert one(spark, exprs.job_name(F.col("x")), x="a b/ü-1_.") == "a_b_ü-1_."
