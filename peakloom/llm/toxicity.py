"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The instances are the overlapping windows of a sentence: every stretch of LENGTHS consecutive symbols, shorter ones at its end. Symbols are
letters (small ones; all beyond a to z share the few codes above, by their number, so letters of other scripts can have one code) and, between words, one space; digits and punctuation go, and so do spaces between words of one letter, so an
insult spelt out in single letters is seen as in one piece. Subsequences run across words, so insults of several words are seen too. Where white space
parts no words, ``train(..., spaces=False)`` leaves it out.
A sentence ends at a line break, or at a full stop, exclamation or question mark before white space.
Two windows are compared by their common letter subsequences of length three: an occurrence that spans s letters weighs DECAY^s, up to
MAX_SPAN letters, so gapped forms and inserted characters still match. The kernel is divided by a norm of the window's length.
A window's coordinates are its kernel values with the landmarks, whitened by the landmarks' own kernel matrix (Nystrom). A linear
SVM on them scores windows; a sentence scores as its highest window, a document as its highest sentence.

Labels mark whole documents, so training alternates: of each toxic document the window that the current machine scores highest stands for the label; windows
drawn from the other documents, and the highest of each of them, stand against it. Landmarks are stretches of MARKS symbols that toxic documents use more than
others, with some common ones; the first machine tells the former from drawn windows, and they go on standing for the label beside the documents' windows. They span the kernel's coordinates; no window is left out for lack of one. Because kernel values with
landmarks are sums over subsequences, the trained machine folds into one weight per subsequence; scoring all windows is then running sums of table lookups.

Only ``labels.toxic`` of rows with crc32(doc_id) mod 5 <> 0 is learnt from, at most ``per_class`` documents a class (the bound on the sample,
drawn by hash). Defined cases: a null or empty text scores as a window without any landmark's letters; without labelled
rows of both classes every score is 0; repeated rows are each scored; texts may have any length, of which a batch is laid out at a time, whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DECAY, MAX_SPAN, CODES = 0.7, 6, 64
SPACE = CODES - 1
#: Letters of a window; the last is the longest. Sentences are PAD empty places apart, so that no window reaches into the next one.
LENGTHS = (5, 6, 7, 8, 9, 10, 12, 24)
PAD, MARKS = LENGTHS[-1], (5, 8)
#: Characters that are laid out at once, and texts at most.
STRETCH = 1 << 16
#: Toxic documents that a stretch must occur in to be a landmark, so that chance stretches of few documents are none.
SUPPORT = 3
#: (second, third) offsets of a subsequence's letters from its first.
OFFSETS = [(a, b) for b in range(2, MAX_SPAN) for a in range(1, b)]


@lru_cache
def _letter_codes() -> np.ndarray:
    return np.array([0 if not chr(p).isalpha() else p - 96 if 97 <= p <= 122 else 27 + p % (SPACE - 27) for p in range(0x110000)], dtype=np.uint8)


def encoded(words: list[str]) -> np.ndarray:
    """(words, most letters + MAX_SPAN) codes of their letters; 0 is none."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = _letter_codes()[np.minimum(points, 0x10FFFF)]
    row = np.cumsum(points == 10)
    letter = code > 0
    code, row = code[letter], row[letter]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.zeros((len(words), int(place.max(initial=-1)) + 1 + MAX_SPAN), dtype=np.int32)
    out[row, place] = code
    return out


def laid_out(texts: list[str | None], spaces: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts in a row, PAD empty places after each sentence and text, and where each text starts.

    a-z are 1 to 26, other letters a code above by their number; all else goes. With spaces, a stretch of white space is one SPACE, and so are a sentence's
    ends; between two words of one letter each there is none, so letters set apart make a word.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    white = (points == 32) | ((points >= 9) & (points <= 13))
    ends = points == 10
    ends[:-1] |= ((points[:-1] == 46) | (points[:-1] == 33) | (points[:-1] == 63)) & white[1:]
    code = _letter_codes()[np.minimum(points, 0x10FFFF)]
    gap = white | ends
    some = np.flatnonzero((code > 0) | gap)
    code, gap, ends = code[some], gap[some], ends[some]
    opens = gap & ~np.concatenate([[False], gap[:-1]])
    run = np.cumsum(opens) - 1
    n_runs = int(run[-1]) + 1
    stops = np.bincount(run, weights=ends, minlength=n_runs) > 0
    letters = np.bincount(run, weights=~gap, minlength=n_runs)  # of the word after a gap
    joined = ~stops & (letters == 1) & (np.concatenate([[0], letters[:-1]]) == 1) if spaces else np.ones(n_runs, dtype=bool)
    width = np.where(gap, PAD * ends, 1)
    width[opens] += np.where(joined, 0, 1)
    last = np.flatnonzero(gap & ~np.concatenate([gap[1:], [False]]))
    stops &= spaces
    width[last] += stops
    place = np.cumsum(width)
    out = np.zeros(int(place[-1]) + PAD, dtype=np.int32)
    out[place[~gap] - 1] = code[~gap]
    first = np.flatnonzero(opens)
    out[(place[first] - width[first])[~joined]] = SPACE
    out[place[last][stops] - 1] = SPACE
    # Each text begins after the line break before it: the texts' own line breaks are told apart by their order.
    breaks = np.flatnonzero(points == 10)
    before = np.cumsum([0, *(t.count("\n") + 1 for t in lowered)])[:-1]
    at = np.searchsorted(some, breaks[before])
    return out, place[at] - 1


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each subsequence (0: none) and its weight, (words, positions x offsets)."""
    n = codes.shape[1] - MAX_SPAN
    first = codes[:, :n]
    index = []
    for a, b in OFFSETS:
        second, third = codes[:, a : a + n], codes[:, b : b + n]
        index.append(np.where((first > 0) & (second > 0) & (third > 0), (first * CODES + second) * CODES + third, 0))
    weight = np.repeat([DECAY ** (b + 1) for _, b in OFFSETS], n)
    return np.concatenate(index, axis=1), weight


def _norms(n: np.ndarray) -> np.ndarray:
    """Of numbers of letters: the root of their squared weights."""
    square = sum(np.maximum(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in OFFSETS)
    return np.sqrt(np.maximum(square, 1e-3))


def _norm(codes: np.ndarray) -> np.ndarray:
    return _norms((codes > 0).sum(axis=1))


class Landmarks:
    """The landmarks' subsequence weights over the subsequences that any of them has: a row for each subsequence, a column for each landmark."""

    def __init__(self, words: list[str] | np.ndarray):
        codes = words if isinstance(words, np.ndarray) else encoded(words)
        index, weight = subsequences(codes)
        self.subsequences = np.union1d(index, [0])
        self.place = np.zeros(CODES**3, dtype=np.int32)  # 0, no letters, is the first subsequence
        self.place[self.subsequences] = np.arange(len(self.subsequences))
        self.columns = np.zeros((len(self.subsequences), len(codes)), dtype=np.float32)
        norm = _norm(codes)
        for k in range(len(codes)):
            np.add.at(self.columns[:, k], self.place[index[k]], weight / norm[k])
        self.columns[0] = 0

    def folded(self, w: np.ndarray) -> np.ndarray:
        """A weight for each subsequence from one for each landmark."""
        out = np.zeros(CODES**3, dtype=np.float32)
        out[self.subsequences] = self.columns @ w
        return out


def kernel(words: list[str] | np.ndarray, landmarks: Landmarks) -> np.ndarray:
    """Kernel values of words, or rows of codes, with landmarks, in stretches."""
    out = np.empty((len(words), landmarks.columns.shape[1]), dtype=np.float32)
    for s in range(0, len(words), 128):
        some = words[s : s + 128]
        codes = some if isinstance(some, np.ndarray) else encoded(some)
        index, weight = subsequences(codes)
        out[s : s + len(codes)] = np.einsum("wpl,p->wl", landmarks.columns[landmarks.place[index]], weight.astype(np.float32)) / _norm(codes)[:, None]
    return out


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by gradient steps with momentum on all rows."""
    x1 = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w, v = np.zeros(x1.shape[1], dtype=np.float32), np.zeros(x1.shape[1], dtype=np.float32)
    weight, y = (weight / weight.sum()).astype(np.float32), y.astype(np.float32)
    rate = np.float32(1 / (2 * np.max(np.einsum("ij,ij->i", x1, x1)) + ridge))
    for _ in range(steps):
        slack = np.maximum(np.float32(0), 1 - y * (x1 @ w))
        g = -2 * (x1.T @ (weight * y * slack)) + np.float32(ridge) * np.append(w[:-1], np.float32(0))
        v = np.float32(0.9) * v - rate * g
        w = w + v
    return w[:-1].astype(np.float64), float(w[-1])


class Machine:
    """The folded machine: a weight per subsequence, and a bias."""

    def __init__(self, table: np.ndarray, bias: float, spaces: bool = False):
        self.table, self.bias, self.spaces = table.astype(np.float32), bias, spaces
        self.table[0] = 0

    def windows(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each of LENGTHS the value, without the bias, of the window from each place of a layout; 0 where no letter is."""
        c = np.concatenate([codes, np.zeros(PAD + MAX_SPAN, dtype=np.int32)]).astype(np.intp)
        n, size = len(codes) + PAD, len(codes)
        first = c[:n] * CODES**2
        pairs = [first + c[a : a + n] * CODES for a in range(1, MAX_SPAN - 1)]
        letters = np.concatenate([[0], np.cumsum(c[:n] > 0)])
        sums = {}
        for b in range(2, MAX_SPAN):
            # Without all three letters the weight is 0.
            total = np.take(self.table, pairs[0] + c[b : b + n])
            for pair in pairs[1 : b - 1]:
                total += np.take(self.table, pair + c[b : b + n])
            sums[b] = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)]) * DECAY ** (b + 1)
        scale = 1 / _norms(np.maximum(np.arange(PAD + 1), LENGTHS[0]))
        for length in LENGTHS:
            value = sums[2][length - 2 : length - 2 + size] - sums[2][:size]
            for b in range(3, MAX_SPAN):
                if length > b:
                    value += sums[b][length - b : length - b + size]
                    value -= sums[b][:size]
            yield np.where(codes > 0, value * scale[letters[length : length + size] - letters[:size]], 0.0)

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the highest window's distance from the boundary, and its codes."""
        codes, starts = laid_out(texts, self.spaces)
        padded = np.concatenate([codes, np.zeros(PAD + MAX_SPAN, dtype=np.int32)])
        value, window = np.full(len(texts), -np.inf), np.zeros((len(texts), PAD + MAX_SPAN), dtype=np.int32)
        for length, v in zip(LENGTHS, self.windows(codes)):
            high = np.maximum.reduceat(v, starts)
            for d in np.flatnonzero(high > value):
                stop = starts[d + 1] if d + 1 < len(starts) else len(v)
                at = starts[d] + int(np.argmax(v[starts[d] : stop]))
                window[d] = 0
                window[d, :length] = padded[at : at + length]
            value = np.maximum(value, high)
        return value + self.bias, window

    def values(self, texts: list[str | None]) -> list[float]:
        """Of each text the highest window's distance from the boundary."""
        out: list[float] = []
        for some in stretches(texts):
            codes, starts = laid_out(some, self.spaces)
            high = np.full(len(codes), -np.inf)
            for v in self.windows(codes):
                np.maximum(high, v, out=high)
            out += (np.maximum.reduceat(high, starts) + self.bias).tolist()
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        return (1 / (1 + np.exp(-4 * np.clip(self.values(texts), -8, 8)))).tolist()


def stretches(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Whole texts in order, together of at most STRETCH characters or a single one."""
    some: list[str | None] = []
    size = 0
    for t in texts:
        if some and size + len(t or "") > STRETCH:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "") + 1
    if some:
        yield some


def _grams(texts: list[str], size: int, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of so many letters within sentences as numbers, and of how many texts each is part."""
    each = [np.zeros(0, dtype=np.int64)]
    for t in texts:
        c = laid_out([t], spaces)[0].astype(np.int64)
        n = len(c) - size + 1
        g, full = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(size):
            g = g * CODES + c[k : k + n]
            full &= c[k : k + n] > 0
        each.append(np.unique(g[full]))
    return np.unique(np.concatenate(each), return_counts=True)


def _ungram(grams: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(grams), max(MARKS) + MAX_SPAN), dtype=np.int32)
    for k in range(size):
        out[:, k] = grams // CODES ** (size - 1 - k) % CODES
    return out


def _marks(pos: list[str], neg: list[str], size: int, n: int, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks of one size as rows of codes: three in four are the stretches that toxic documents use far more than others, with by how far, the rest common ones with 0."""
    (g_pos, n_pos), (g_neg, n_neg) = _grams(pos, size, spaces), _grams(neg, size, spaces)
    at = np.searchsorted(g_neg, g_pos)
    met = at < len(g_neg)
    met[met] = g_neg[at[met]] == g_pos[met]
    expected = np.zeros(len(g_pos))
    expected[met] = n_neg[at[met]] / len(neg) * len(pos)
    lift = (n_pos - expected) / np.sqrt(expected + 0.5)
    top = np.lexsort((g_pos, -lift))[: n * 3 // 4]
    top = top[(lift[top] > 0) & (n_pos[top] >= SUPPORT)]
    common = g_neg[np.lexsort((g_neg, -n_neg))]
    common = common[~np.isin(common, g_pos[top])][: n // 4]
    return _ungram(np.concatenate([g_pos[top], common]), size), np.concatenate([np.maximum(lift[top], 0), np.zeros(len(common))])


def _drawn(texts: list[str], each: int, spaces: bool, seed: int = 8) -> np.ndarray:
    """Windows of all lengths from places drawn in each text, as rows of codes."""
    draw, out = np.random.default_rng(seed), []
    for t in texts:
        c = laid_out([t], spaces)[0]
        letters = np.flatnonzero(c)
        if len(letters):
            c = np.concatenate([c, np.zeros(PAD, dtype=np.int32)])
            for at, length in zip(draw.choice(letters, each), draw.choice(LENGTHS, each)):
                row = np.zeros(PAD + MAX_SPAN, dtype=np.int32)
                row[:length] = c[at : at + length]
                out.append(row)
    return np.array(out, dtype=np.int32).reshape(-1, PAD + MAX_SPAN)


def _against(windows: np.ndarray, landmarks: Landmarks) -> np.ndarray:
    """Kernel values of windows with landmarks; those of sentences under LENGTHS[0] letters count as that long."""
    n = (windows > 0).sum(axis=1)
    return kernel(windows, landmarks) * (_norms(n) / _norms(np.maximum(n, LENGTHS[0])))[:, None].astype(np.float32)


def _highest(machine: Machine, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    value, window = zip(*(machine.best(some) for some in stretches(texts)))
    return np.concatenate(value), np.concatenate(window)


def train(texts: list[str], toxic: list[int], n_landmarks: int = 800, rounds: int = 6, clean_windows: int = 6, spaces: bool = True) -> Machine:
    """From labelled documents. The windows of their sentences are the instances."""
    pos = [d for d, t in zip(texts, toxic) if t]
    neg = [d for d, t in zip(texts, toxic) if not t]
    none = Machine(np.zeros(CODES**3), -10.0)
    if not pos or not neg:
        return none
    marks, first = map(np.concatenate, zip(*(_marks(pos, neg, size, n_landmarks // len(MARKS), spaces) for size in MARKS)))
    if not first.any():
        return none
    z = Landmarks(marks)
    value, vector = np.linalg.eigh((z.columns.T @ z.columns).astype(np.float64))
    keep = value > 1e-4 * value[-1]
    white = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    x_neg = _against(_drawn(neg, clean_windows, spaces), z) @ white

    def machine_of(x_pos: np.ndarray, each: np.ndarray) -> Machine:
        weight = np.concatenate([each / each.sum(), np.full(len(x_neg), 2 / len(x_neg))])
        w, b = train_svm(np.concatenate([x_pos, x_neg]), np.concatenate([np.ones(len(x_pos)), -np.ones(len(x_neg))]), weight)
        return Machine(z.folded(white @ w), b, spaces)

    # The first machine tells the landmarks that toxic documents use more from windows of others; they stay beside the documents' windows, for insults that never stand alone.
    x_marks, w_marks = _against(marks[first > 0], z) @ white, first[first > 0] / first.sum()
    machine = machine_of(x_marks, w_marks)
    for turn in range(rounds):
        # Of each toxic document the highest window; the highest of each clean document joins the clean side.
        value, mine = _highest(machine, pos)
        x_pos = _against(mine if turn == 0 else mine[value > -0.5], z) @ white
        if not len(x_pos):
            return none
        x_neg = np.concatenate([x_neg, _against(_highest(machine, neg)[1], z) @ white])
        machine = machine_of(np.concatenate([x_pos, x_marks]), np.concatenate([np.full(len(x_pos), 1 / len(x_pos)), w_marks]))
    machine.bias -= boundary(machine.values(texts), toxic)
    return machine


def boundary(values: list[float], toxic: list[int]) -> float:
    """Midway in the stretch of values that splits the classes best, each class weighing the same."""
    order = np.argsort(values)
    v, y = np.asarray(values)[order], np.asarray(toxic)[order]
    right = np.concatenate([[0], np.cumsum(np.where(y == 0, 1 / (y == 0).sum(), -1 / (y == 1).sum()))])
    k = int(np.argmax(right))
    return float((v[max(k - 1, 0)] + v[min(k, len(v) - 1)]) / 2)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> tuple[list[str], list[int]]:
    """At most per_class documents of each class, those with the smallest hashes of the ids that may be learnt from."""
    allowed = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    some = lambda t: allowed.where(F.col("toxic") == t).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = some(1).unionByName(some(0))
    # At most 2 * per_class ids of 12 bytes: a size-bounded broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", "toxic").collect()
    rows = sorted({(r.text, r.toxic) for r in rows})
    return [r[0] for r in rows], [r[1] for r in rows]


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of each document (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, score double")


def detect(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    machine = train(*training_sample(docs, labels, per_class))
    scored = score_documents(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
