import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from peakloom.operators.medians import medians


def test_large_groups_are_refined(spark):
    draw = random.Random(1)
    spread = {
        "even": [draw.gauss(0, 1) for _ in range(500)], "odd": [draw.lognormvariate(0, 40) for _ in range(501)], "signs": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(400)],
        "same": [2.5] * 300, "two": [1.0] * 150 + [3.0] * 150, "close": [1.0 + k * 2**-52 for k in range(301)], "zeros": [0.0, -0.0] * 150 + [5.0], "tails": [-math.inf] * 60 + [7.0] * 90 + [math.inf] * 60,
        "tiny": [5e-324 * k for k in range(201)], "huge": [1.7e308 - k * 1e305 for k in range(-40, 240)], None: [draw.uniform(-9, 9) for _ in range(250)],
    }
    rows = [(k, v, -v) for k, vs in spread.items() for v in vs] + [("even", None, None), ("none", None, None)] + [("few", float(v), None) for v in (3, 1, 2)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(g, "extra", v, w, 1) for g, v, w in rows], "g string, name string, v double, w double, rank int")
    got = {r.g: r for r in medians(df, ["g"], {"a": F.col("v"), "b": F.col("w")}, large=150).collect()}
    assert len(got) == len(spread) + 2
    for g, vs in spread.items():
        want = statistics.median(vs) if len(vs) % 2 or abs(max(vs)) < 1e308 else sorted(vs)[len(vs) // 2 - 1] / 2 + sorted(vs)[len(vs) // 2] / 2
        assert got[g].a == pytest.approx(want, rel=1e-12), g
        assert got[g].b == pytest.approx(-want, rel=1e-12), g
    assert got["none"].a is None and (got["few"].a, got["few"].b) == (2.0, None)


def test_agrees_with_the_built_in_median(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.sin("id").alias("v"))
    a = {r.g: r.v for r in medians(df, ["g"], {"v": F.col("v")}, large=10).collect()}
    b = {r.g: r.v for r in df.groupBy("g").agg(F.median("v").alias("v")).collect()}
    assert a == pytest.approx(b, rel=1e-14)
