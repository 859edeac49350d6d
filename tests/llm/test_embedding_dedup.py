import math
import random

import numpy as np

from peakloom.llm import embedding_dedup
from peakloom.llm.embedding_dedup import Forest, Index, near_vectors, unit

SCHEMA = "vec_id long, embedding array<{}>, label int, node long, w long, packed string, root long, n_links int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x", 4, 5) for i, v in rows], SCHEMA.format(kind))


def brute(rows, cosine=0.95, real=np.float32):
    width = max((len(v) for _, v in rows if v is not None), default=0)
    usable = []
    for _, v in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable.append(np.array([*v, *[0.0] * (width - len(v))], dtype=real).astype(float) if ok else None)
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(usable):
        for j, y in enumerate(usable[:i]):
            if x is not None and y is not None and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, n[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)], key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(draw, n=300, width=24, groups=25):
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [(k, [c + draw.gauss(0, draw.choice([0.0, 0.05, 0.15, 0.3])) for c in draw.choice(centres)]) for k in range(n)]


ODD = [(900, None), (901, [0.0] * 24), (902, [math.nan] * 24), (903, [None] + [1.0] * 23), (904, [1.0]), (905, [2.0]), (906, []), (None, [0.0, 1.0]), (None, [0.0, 3.0]), (907, [1.0]), (904, [1.0])]


def test_matches_brute_force_over_lists_and_blocks(spark):
    rows = clustered(random.Random(1)) + ODD
    want = brute(rows)
    assert 500 < sum(r[1] for r in want) < 5000
    assert got(near_vectors(frame(spark, rows))) == want
    assert got(near_vectors(frame(spark, rows), list_rows=20, block=16)) == want
    assert got(near_vectors(frame(spark, rows), list_rows=20, block=16, sample_rows=10)) == want


def test_one_large_group_of_near_copies(spark, monkeypatch):
    draw = random.Random(2)
    base = [draw.gauss(0, 1) for _ in range(16)]
    rows = [(k, [c + draw.gauss(0, 0.05) for c in base]) for k in range(150)] + [(k, base) for k in range(150, 300)] + [(k, [draw.gauss(0, 1) for _ in range(16)]) for k in range(300, 420)]
    monkeypatch.setattr("peakloom.llm.common.HOT", 4)  # the equal vectors and the large component are looked up by broadcast
    assert got(near_vectors(frame(spark, rows), list_rows=30, block=32)) == brute(rows)


def test_components_of_any_size(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [-1e300, 1e300]), (4, [-5.0, 5.0])]
    assert [(r[1], r[2]) for r in got(near_vectors(frame(spark, rows, "double")))] == [(1, 1), (1, 1), (1, 3), (1, 3)]


def test_empty_tables(spark):
    assert got(near_vectors(frame(spark, []))) == []
    assert got(near_vectors(frame(spark, [(1, None), (2, [])]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_only_what_the_codes_cannot_rule_out_is_compared():
    draw = np.random.default_rng(3)
    points = unit(np.concatenate([draw.normal(size=(1000, 32)), draw.normal(size=(1, 32)) + 0.1 * draw.normal(size=(40, 32))]))
    index = Index.fitted(points, 6, 4, "<f8")
    radius = math.sqrt(0.1)
    own, codes, loss, probes = index.coded(points, radius)
    close = {(i, j) for i, j in zip(*np.nonzero(points @ points.T >= 0.95)) if i < j}
    assert len(close) > 200
    for i, j in close:
        lo, hi = sorted((i, j), key=lambda k: own[k])
        assert own[lo] == own[hi] or own[hi] in probes[lo]
        decoded = index.centroids[own[j]] + np.concatenate([index.words[s][codes[j, s]] for s in range(4)])
        assert np.linalg.norm(points[i] - decoded) <= radius + loss[j] + 1e-3


def test_forest_joins_what_hangs_together():
    draw = random.Random(4)
    for _ in range(50):
        forest, up = Forest(30), list(range(30))
        for _ in range(4):
            pairs = [(draw.randrange(30), draw.randrange(30)) for _ in range(6)]
            forest.join(*map(np.array, zip(*pairs)))
            for a, b in pairs:
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = [new if u == old else u for u in up]
        assert forest.up.tolist() == up


def test_recall_is_whole_on_random_vectors(spark):
    draw = np.random.default_rng(5)
    points = draw.normal(size=(600, 5))
    rows = [(k, v) for k, v in enumerate(points.tolist())]
    want = brute(rows, real=np.float64)
    assert sum(r[1] for r in want) > 50
    assert got(near_vectors(frame(spark, rows, "double"), list_rows=15)) == want
    assert embedding_dedup.SLACK > 0
