import random
import re
import zlib
from collections import Counter

from peakloom.llm import spelling
from tests.llm.data import frame, simple

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, rate=97, least_length=5, least_n=3):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % rate == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_n}
    out = {}
    for w in n:
        partners = [v for v in n if near(w, v)]
        best = min(partners, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best is not None and n[best] >= 2 * n[w] else None, len(partners)]
    for w in n:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return sorted((w, f, root, n[w], k, n[f] if f else None) for w, (f, k, root) in out.items())


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def texts(draw, size=400, letters="abcé"):
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 8))) for _ in range(120)]
    return [(k, " ".join(draw.choice(words[: 1 + draw.randrange(len(words))]).title() for _ in range(20))) for k in range(size // 20)]


def test_matches_brute_force(spark):
    rows = [*texts(random.Random(4)), (None, "apple apple apply apply apply apply apply apply"), (None, None), (7, ""), (7, "apple÷apple ×apple3aapple")]
    assert got(spelling.variants(simple(spark, rows), rate=5)) == brute(rows, rate=5)


def test_large_partitions_are_split_without_loss(spark, monkeypatch):
    rows = texts(random.Random(5), 1200, "ab")
    want = brute(rows)
    assert sum(r[4] for r in want) > 150
    assert got(spelling.variants(simple(spark, rows), block=12)) == want
    monkeypatch.setattr(spelling, "HOT", 10**9)  # every partition over the block is split before it is shuffled
    assert got(spelling.variants(simple(spark, rows), block=12)) == want


def test_words_of_any_length(spark):
    long = "abcdefghij" * 700
    rows = [(k, f"{long} {long} {long}x {long[:-1]} {'a' * 6000} {'a' * 5999}") for k in range(3)]
    assert got(spelling.variants(simple(spark, rows), block=5000)) == brute(rows)


def test_all_lengths_down_to_one(spark):
    rows = texts(random.Random(6), 300)
    assert got(spelling.variants(simple(spark, rows), rate=3, least_length=1, least_n=1)) == brute(rows, 3, 1, 1)


def test_pairs_are_met_once():
    draw = random.Random(1)
    for _ in range(200):
        o, letters = draw.randint(1, 4), draw.choice(["ab", "abcé"])
        opens = sorted({"".join(draw.choice(letters) for _ in range(o + draw.randint(0, 1))) for _ in range(30)})
        found = sorted(tuple(sorted(p)) for p in spelling.near_pairs(opens, o))
        assert found == [(i, j) for i in range(len(opens)) for j in range(i + 1, len(opens)) if near(opens[i], opens[j]) and min(len(opens[i]), len(opens[j])) == o]


def test_runs_are_those_of_the_pattern():
    draw = random.Random(2)
    for _ in range(3000):
        text = "".join(draw.choice("aZé×÷ ½¿Ā’ßÿ\U0001f600,\x00") for _ in range(12))
        assert [r.decode() for r in spelling.runs(text.encode())] == ["".join(c.lower() if "A" <= c <= "Z" else c for c in r) for r in RUN.findall(text)]


def test_chains_and_ties(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 12, "ccccc": 3, "ccccd": 6, "cccce": 6}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    df = {r[0]: r[1:] for r in got(spelling.variants(simple(spark, rows), rate=10**9 + 7))}
    assert df["aaaaa"][:2] == ("aaaab", "aaabb") and df["ccccc"][:2] == ("ccccd", "ccccd") and df["aaabb"][0] is None


def test_empty_tables(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(simple(spark, [(1, "one two"), (2, None)])).collect() == []
