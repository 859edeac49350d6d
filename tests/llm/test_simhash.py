import random

import numpy as np
import xxhash

from peakloom.llm import simhash
from tests.llm.data import frame, odd_documents, simple


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    fps = [brute_fp(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, *_) in enumerate(rows)], key=str)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('aé b')").first()[0] % 2**64 == xxhash.xxh64_intdigest("aé b".encode(), 42)


def test_masks_cover_every_pair_within_the_radius():
    draw = random.Random(1)
    for radius in (1, 3, 4):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        assert all(20 <= (m % 2**64).bit_count() <= 45 for m in masks)
        for _ in range(3000):
            flips = sum(1 << b for b in draw.sample(range(64), radius))
            assert any(m & flips == 0 for m in masks)


def test_odd_documents(spark):
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark)).collect()), key=str)
    assert got == brute(odd_documents())


def chains(n=700):
    """Fingerprints in dense clouds and long chains."""
    draw, out = random.Random(7), []
    for _ in range(4):
        base = draw.getrandbits(64)
        out += [base ^ sum(1 << b for b in draw.sample(range(12), draw.randint(0, 6))) for _ in range(n // 8)]
        x = base ^ (0xFFFF << 40)
        for _ in range(n // 8):
            x ^= sum(1 << b for b in draw.sample(range(64), 4))
            out.append(x)
    return sorted({x - 2**64 if x >= 2**63 else x for x in out})


def test_links_with_tiny_blocks_connect_the_same(spark):
    fps = chains()
    frame_ = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    want = {}
    for member, root in simhash.forest(np.array(fps), 4):
        want[member] = root
    for block in (4096, 5):
        edges = simhash.links(frame_, 4, block)
        assert all(((a ^ b) % 2**64).bit_count() <= 64 and a > b for a, b in edges.collect())
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        groups = lambda m: {frozenset([f for f in fps if m.get(f, f) == k]) for k in {m.get(f, f) for f in fps}}
        assert groups(roots) == groups(want)


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(5, text), (3, text), (9, text + " end"), (7, "other words altogether here"), (3, text)]
    kept = simhash.one_of_each(simple(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 7]


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert [r.component_id for r in simhash.near_duplicates(simple(spark, [(4, ""), (2, None)])).collect()] == [2, 2]


def test_one_of_each_keeps_what_is_nobodys_duplicate(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcd")
    rows = [(5, a), (5, b), (3, a + " end"), (None, c), (None, d), (None, c)]
    kept = simhash.one_of_each(simple(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", a + " end"), ("5", b), ("None", c), ("None", d)])


def test_finer_masks_miss_no_pair_of_a_bucket():
    draw = random.Random(3)
    for m in simhash.masks(4):
        still = [b for b in range(64) if not (m % 2**64) >> b & 1]
        some = simhash.finer(m, 4)
        assert len(some) == 5 and all(x & m == m for x in some)
        for _ in range(200):
            flips = sum(1 << b for b in draw.sample(still, 4))
            assert any((x % 2**64) & flips == 0 for x in some)
