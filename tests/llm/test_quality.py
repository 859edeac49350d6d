import random

from peakloom.llm import quality
from tests.llm.data import frame, odd_documents, simple


def brute_repeats(words):
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(k, k + 8))
    return len(inside)


def test_repeated_words():
    draw = random.Random(2)
    for n in (0, 5, 8, 9, 40, 120):
        for kinds in (1, 2, 5):
            words = [draw.choice("abcde"[:kinds]) for _ in range(n)]
            assert quality.repeated_words(words) == brute_repeats(words)
    words = [f"w{k}" for k in range(60)]
    assert quality.repeated_words(words) == 0
    assert quality.repeated_words(words + words[10:22]) == 24


def test_statistics(spark):
    got = quality.judge(frame(spark)).collect()
    assert len(got) == len(odd_documents())
    by = {r.doc_id: r for r in got}
    assert (by[12].n_words, by[12].base_failed, by[12].kept) == (0, True, False)
    assert (by[14].n_words, by[14].word_chars) == (1, 3)
    assert by[0].n_dup_lines == 0 and not by[0].base_failed


def test_cascade_order_changes_no_verdict():
    docs = [quality.Document(r[1]) for r in odd_documents()]
    noisy = [quality.Document("word### " * 5 + " ".join(f"w{k}" for k in range(30))), quality.Document(" ".join(f"SHOUT{chr(65 + k)}!!" for k in range(26)))]
    ordered = quality.order_rules(docs + noisy)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.RULES)
    for d in docs + noisy:
        verdicts = {quality.first_rejection(d, list(c)) is None for c in (ordered, quality.RULES, ordered[::-1])}
        assert len(verdicts) == 1
    assert all(quality.first_rejection(d, ordered) for d in noisy)


def test_rejecting_and_cheap_rules_come_first():
    rules = (quality.Rule("never", lambda d: False), quality.Rule("slow", lambda d: sum(range(30_000)) >= 0), quality.Rule("fast", lambda d: True))
    assert [r.name for r in quality.order_rules([quality.Document("a")] * 20, rules)] == ["fast", "slow", "never"]


def test_filter(spark):
    good = " ".join(f"word{k}" for k in range(50))
    rows = [(1, good), (2, "x y"), (3, None), (4, "### " * 40), (5, good + " same line")]
    assert sorted(r.doc_id for r in quality.keep_good(simple(spark, rows)).collect()) == [1, 5]


def test_empty(spark):
    assert quality.judge(frame(spark, [])).collect() == []


def test_statistics_are_computed_when_a_rule_asks(monkeypatch):
    def refuse(*_):
        raise AssertionError

    monkeypatch.setattr(quality, "repeated_words", refuse)
    short = quality.Document("x y")
    assert quality.first_rejection(short, list(quality.BASE)) == "few_words" and "n_symbols" not in vars(short)


def test_cascade_of_a_table(spark):
    rules = (*quality.BASE, quality.Rule("never", lambda d: False), quality.Rule("slow", lambda d: sum(range(30_000)) >= 0), quality.Rule("fast", lambda d: True))
    names = [r.name for r in quality.ordered_on_sample(frame(spark), rules, sample_rows=10)]
    assert sorted(names) == sorted(r.name for r in rules) and names.index("fast") < names.index("slow") < names.index("never")
    assert quality.ordered_on_sample(frame(spark, []), rules) == list(rules)
    verdicts = [{str(r) for r in quality.keep_good(frame(spark), some).collect()} for some in (quality.RULES, quality.RULES[::-1])]
    assert verdicts[0] == verdicts[1]
