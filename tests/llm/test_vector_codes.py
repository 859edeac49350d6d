import hashlib
import math
import random

import numpy as np

from peakloom.llm import vector_codes
from peakloom.llm.vector_codes import Codebooks, compress, op12_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n long, none int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2, 3) for i, v, l in rows], SCHEMA)


def brute(rows, size, rounds=4, width=None):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = width or -(-max(len(v) for _, v, _ in kept) // 4) * 4
    parts = []
    for _, v, _ in kept:
        x = [math.floor(1024 * float(np.float32(c))) for c in v] + [0] * (width - len(v))
        parts.append([x[p * width // 4 : (p + 1) * width // 4] for p in range(4)])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(c)) for c in kept[k][1]]))
    books = [[parts[k][p] for k in order[:size]] for p in range(4)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            mine = {}
            for x in (q[p] for q in parts):
                mine.setdefault(near(p, x)[1], []).append(x)
            for j, xs in mine.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    out, labels = [], {}
    for (i, _, l), q in zip(kept, parts):
        found = [near(p, q[p]) for p in range(4)]
        out.append([i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), l])
        labels[l] = labels.get(l, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, code, e, labels[l], sha) for i, code, e, l in out], key=str)


def run(spark, rows, monkeypatch, tmp_path, size=256):
    path = str(tmp_path / "t")
    frame(spark, rows).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    whole = compress
    monkeypatch.setattr(vector_codes, "compress", lambda df: whole(df, size))
    return sorted((tuple(r) for r in op12_vector_codes(spark, path).collect()), key=str)


def rows_of(draw, n, width, spread=1.0):
    return [(k, [draw.gauss(0, spread) for _ in range(width)], draw.choice([None, 0, 1])) for k in range(n)]


def test_matches_brute_force(spark, monkeypatch, tmp_path):
    draw = random.Random(1)
    rows = rows_of(draw, 120, 16)
    rows += [(500, None, 1), (501, [None] * 16, 1), (502, [math.inf] * 16, 2), (503, [math.nan] + [0.0] * 15, 2), (None, rows[3][1], None), (5, rows[5][1], 1), (5, rows[6][1], 1), (504, [0.0] * 16, 9)]
    assert run(spark, rows, monkeypatch, tmp_path, 20) == brute(rows, 20)


def test_fewer_vectors_than_entries_and_short_vectors(spark, monkeypatch, tmp_path):
    rows = [(1, [0.5, -0.25, 1.0], 1), (2, [1.0], 1), (3, [], None), (4, [0.1] * 7, 2)]
    assert run(spark, rows, monkeypatch, tmp_path) == brute(rows, 256)


def test_empty_tables(spark, monkeypatch, tmp_path):
    assert run(spark, [(1, None, 1), (2, [math.nan], 1)], monkeypatch, tmp_path) == []


def test_bounds_never_lose_the_nearest():
    draw = np.random.default_rng(2)
    for width, scale in ((1, 50), (3, 3), (16, 300), (20, 2**24), (64, 4)):
        entries = draw.integers(-scale, scale + 1, (64, width))
        parts = np.concatenate([draw.integers(-scale, scale + 1, (700, width)), entries, entries + draw.integers(-1, 2, entries.shape)])
        books = Codebooks(entries[None])
        index, error = vector_codes.nearest(parts, entries, books.steps[0])
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_bounds_drop_entries():
    draw = np.random.default_rng(3)
    entries = draw.integers(-1000, 1000, (8, 1)) + draw.integers(-20, 20, (8, 16))
    assert len(vector_codes.levels(16)) == 2
    x, e = np.repeat(np.arange(8), 8), np.tile(np.arange(8), 8)
    step = Codebooks(entries[None]).steps[0]
    coarse, fine = (vector_codes._bound(s, s, x, e) for s in step)
    exact = ((entries[x] - entries[e]) ** 2).sum(axis=1)
    assert (coarse <= exact).all() and (fine <= exact).all() and fine.sum() >= coarse.sum() > exact.sum() / 2


def test_components_beyond_the_range(spark, monkeypatch, tmp_path):
    rows = [(1, [1e30, -1e30, 0.0, 5.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)]
    out = run(spark, rows, monkeypatch, tmp_path)
    assert [r[2] for r in out] == [0, 0]
