import random
import zlib

import numpy as np

from peakloom.llm import toxicity
from tests.llm.data import frame, odd_documents


def brute_kernel(a, b):
    """Common length-three letter subsequences by decay to the spans, over norms of the lengths."""

    def weights(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.MAX_SPAN)):
                    out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def norm(w):
        n = len(w)
        return np.sqrt(max(1e-3, sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + toxicity.MAX_SPAN)))))

    x, y = weights(a), weights(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / norm(a) / norm(b)


def test_kernel():
    words = ["abcab", "xabc", "aabbcc", "zzz", "ab", "abxcabc"]
    got = toxicity.kernel(words, toxicity.Landmarks(words))
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)


def corpus(n=240):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(draw.randint(1, 4)))
    rows, labels = [], []
    for k in range(n):
        words, toxic = [word() for _ in range(60)], k % 4 == 0
        if toxic:
            bad = draw.choice(["wretch", "scoundrel", "imbecile"])
            if k % 8 == 0 and draw.random() < 0.5:
                bad = bad[:3] + "x" + bad[3:]
            words.insert(draw.randint(0, 50), bad)
        rows.append((k, " ".join(words) + ".", "en", "s", 0, 0, 0, "", "", 0))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_learns_and_tolerates_gaps(spark):
    rows, labels = corpus()
    rows += [(1000, "ther on w.r.e.t.c.h anre", "en", "s", 0, 0, 0, "", "", 0), (1001, "on s c o u n d r e l ther", "en", "s", 0, 0, 0, "", "", 0), (1002, "imbbecile on", "en", "s", 0, 0, 0, "", "", 0), (1003, None, "", "", 0, 0, 0, "", "", 0), (1004, "", "", "", 0, 0, 0, "", "", 0)]
    got = {r.doc_id: r for r in toxicity.detect(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert len(held) > 20 and np.mean([p == t for p, t in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert [got[k].predicted for k in range(1000, 1005)] == [1, 1, 1, 0, 0]


def test_odd_documents_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.detect(frame(spark), labels).collect()
    assert len(got) == len(odd_documents()) and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    assert toxicity.detect(frame(spark, []), labels).collect() == []


def test_insults_of_several_words_or_split_by_spaces(spark):
    draw = random.Random(9)
    rows, labels = corpus()
    texts = [r[1].split(" ") for r in rows]
    for k, words in enumerate(texts):
        at = [draw.randint(0, 20), draw.randint(25, 40), draw.randint(45, 55)]
        if k % 12 == 0:
            words[:] = [w for w in words if not any(c in w for c in "wcmx")]  # no other insult
            words[at[0] : at[0]] = ["you", "are", "nothing"]
        else:
            for place, w in zip(at, draw.sample(["you", "are", "nothing"], 3)):
                words.insert(place, w)
    rows = [(r[0], " ".join(words), *r[2:]) for r, words in zip(rows, texts)]
    plain = rows[1][1]
    new = ["ther on you are nothing anre", "ther on wre tch anre", "on s  c  o  u  n  d  r  e  l ther", "ther nothing on anre erti are thon therer you on", plain]
    rows += [(1000 + k, t, "en", "s", 0, 0, 0, "", "", 0) for k, t in enumerate(new)]
    got = {r.doc_id: r.predicted for r in toxicity.detect(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[1000 + k] for k in range(5)] == [1, 1, 1, 0, 0]


def test_windows_are_the_kernel_of_their_letters():
    texts = ["abc abd, xab c. cab bac ab", None, "zzabcz"]
    marks = ["abcab", "bacab"]
    z = toxicity.Landmarks(marks)
    machine = toxicity.Machine(z.folded(np.array([1.0, 0.5])), 0.0)
    value = lambda s: sum(brute_kernel(s, m) * u for m, u in zip(marks, (1.0, 0.5)))
    least = toxicity._norms(np.array(toxicity.LENGTHS[0]))
    scale = lambda s: min(1.0, float(toxicity._norms(np.array(len(s))) / least))
    sentences = [["abcabdxabc", "cabbacab"], [""], ["zzabcz"]]
    want = [max(value(s[i : i + n]) * scale(s[i : i + n]) for s in each for n in toxicity.LENGTHS for i in range(max(1, len(s)))) for each in sentences]
    assert np.allclose(machine.values(texts), want, atol=1e-5)
    assert np.allclose(machine.best(texts)[0], want, atol=1e-5)


def test_letters_after_the_twenty_fourth():
    rows, labels = corpus()
    machine = toxicity.train([r[1] for r in rows], [t for _, _, t in labels])
    ahead = "theronanretitheronanretitheronanreti"
    for bad in ("wretch", "scoundrel", "imbecile"):
        dull, glued, spaced = machine.values([ahead, ahead + bad, " ".join(ahead + bad)])
        assert dull < 0 < glued and abs(spaced - glued) < 1e-6
    assert (toxicity.encoded(["a" * 40]) > 0).sum() == 40


def test_layout_with_spaces():
    codes, starts = toxicity.laid_out(["ab  cd. e f g hi", "", None, "x! Y\nz-w 12 q"], spaces=True)
    said = lambda c: "".join("." if x == 0 else "_" if x == toxicity.SPACE else chr(96 + x) for x in c).strip(".")
    each = [said(c) for c in np.split(codes, starts[1:])]
    assert [[s.strip("_") for s in e.split(".") if s.strip("_")] for e in each] == [["ab_cd", "efg_hi"], [], [], ["x", "y", "zw_q"]]
    assert codes[starts[0] + 1] == 1 and (codes == toxicity.SPACE).sum() == 15


def test_a_word_of_one_language_is_no_insult_in_pieces_of_two_words():
    draw = random.Random(6)
    parts = ["le", "ra", "mi", "do", "su", "pa", "ne"]
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(1, 3)))
    texts = []
    for k in range(400):
        words = [w for w in (word() for _ in range(40)) if "rami" not in w]
        words.insert(draw.randint(0, 30), "ramido" if k % 4 == 0 else "lera midole")
        texts.append(" ".join(words) + ".")
    machine = toxicity.train(texts[:320], [int(k % 4 == 0) for k in range(320)])
    right = [(v > 0) == (k % 4 == 0) for k, v in enumerate(machine.values(texts))][320:]
    assert np.mean(right) > 0.9
