from collections import defaultdict

import pytest

from peakloom.llm import mixing
from tests.llm.data import frame, odd_documents, simple


def n_words(t):
    return len((t or "").encode().split())


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """The excess of capped sources goes to the others by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / ws > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / ws for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for i, t, _, source, *_ in rows:
        sizes[source] += n_words(t)
    want, taken, ties = targets(sizes), defaultdict(int), len(rows)
    ids = {(i, n_words(t)): s for i, t, _, s, *_ in rows}
    for r in got:
        source = next(s for s in sizes if sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-3)
        taken[source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and (r.doc_id, r.size) in ids
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=ties)


def test_odd_documents(spark):
    got = mixing.mix_sources(frame(spark)).collect()
    assert len(got) == len(odd_documents())
    check(odd_documents(), got)


def test_near_target_and_nested(spark):
    rows = [(k, "w " * (k % 17 + 1), f"s{k % 7}" if k % 3 else "hot") for k in range(900)]
    docs = simple(spark, rows)
    low, high = ({r.doc_id: r.taken for r in mixing.mix_sources(docs, share=s).collect()} for s in (0.5, 0.8))
    assert sum(low.values()) == pytest.approx(0.5 * sum(n_words(t) for _, t, _ in rows), abs=10)
    assert all(low[k] <= high[k] for k in low)


def test_apply(spark):
    docs = frame(spark)
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert sum(n_words(r.text) for r in out.collect()) == sum(r.taken for r in mixing.mix_sources(docs).collect())


def test_reruns_agree(spark):
    first, again = (sorted(map(str, mixing.mix_sources(frame(spark)).collect())) for _ in range(2))
    assert first == again


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix_sources(simple(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_a_cut_text_keeps_its_white_space(spark):
    text = " one\ttwo\n\nthree  four\x0bfive six \n"
    for share in (0.2, 0.4, 0.7, 0.9):
        (row,) = mixing.apply_mix(simple(spark, [(1, text)]), share=share).collect()
        k = int(6 * share)
        words = text.encode().split()[:k]
        assert text.startswith(row.text) and row.text.encode().split() == words and row.text.endswith(words[-1].decode())
