"""Quality rules as a short-circuit cascade.

Rules are tests on a document's statistics, each computed when a rule first asks for it. On a bounded sample (``sample_rows`` documents, drawn by hash)
each rule's cost (CPU seconds a document, its statistics included) and selectivity (share it rejects) are measured by the executors, and the rules are ordered by
rejection per cost. A document then meets the rules in that order and is judged by no rule after the first that rejects it. All rules are rejections, so
the order changes only the cost, never the verdict. The base rule takes part in ``keep_good``; ``judge`` returns all its statistics, so there it comes first.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged each; texts may have any length, one text's words being held at a time beside a batch of whole texts; an empty table gives an
empty result; other columns are ignored (``judge``) or passed through (``keep_good``); names beginning with ``__pl_`` are reserved.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 8
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[ \t\n\r\x0b\f]+")


def words_of(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w]


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words in windows of `size` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    # Windows get numbers by doubling: a window of 2k words is a pair of windows of k words. Exact, without hashing.
    span = 1
    while span < size:
        step = min(span, size - span)
        ids = np.unique(ids[: len(ids) - step] * np.int64(len(words) + 1) + ids[step:], return_inverse=True)[1]
        span += step
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Document:
    """A text and its statistics."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOLS.findall(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\r\x0b\f")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return _few_words(self) or _repeats(self)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _few_words(d: Document) -> bool:
    return d.n_words < 20


def _repeats(d: Document) -> bool:
    return 100 * d.n_repeat_words > 30 * d.n_words


def _shouted(d: Document) -> bool:
    return 2 * sum(map(str.isupper, d.text)) > d.word_chars


def _few_letters(d: Document) -> bool:
    return 2 * sum(map(str.isalpha, d.text)) < d.word_chars


#: The two halves of the base rule.
BASE = (Rule("few_words", _few_words), Rule("repeats", _repeats))
RULES = (
    Rule("word_length", lambda d: d.word_chars > 25 * d.n_words or d.word_chars < 2 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("duplicate_lines", lambda d: 10 * d.n_dup_lines > 5 * len(d.lines)),
    Rule("shouted", _shouted),
    Rule("few_letters", _few_letters),
    Rule("stutter", lambda d: 10 * sum(map(str.__eq__, d.words, d.words[1:])) > 3 * d.n_words),
    Rule("exclaimed", lambda d: 4 * d.text.count("!") > d.n_words),
)


def measured(texts: list[str], rules=RULES) -> list[tuple[int, float]]:
    """Of each rule: rejected texts and CPU seconds. Each rule meets fresh documents, so it pays for the statistics that it asks for."""
    out = []
    for r in rules:
        docs = list(map(Document, texts))
        began = time.thread_time()
        rejected = sum(map(r.rejects, docs))
        out.append((rejected, time.thread_time() - began))
    return out


def by_gain(rules, figures: list[tuple[int, float]]) -> list[Rule]:
    """By rejection per cost; equal ones keep their order."""
    gain = {r.name: rejected / max(seconds, 1e-9) for r, (rejected, seconds) in zip(rules, figures)}
    return sorted(rules, key=lambda r: -gain[r.name])


def order_rules(sample: list[Document], rules=RULES) -> list[Rule]:
    return by_gain(rules, measured([d.text for d in sample], rules))


def first_rejection(d: Document, cascade: list[Rule]) -> str | None:
    return next((r.name for r in cascade if r.rejects(d)), None)


def ordered_on_sample(docs: DataFrame, rules=RULES, sample_rows: int = 1000) -> list[Rule]:
    """The cascade by figures of the texts with the smallest hashes: a bounded sample, the same on each run. Hashes alone are ordered; texts below the last of them are
    measured where they are, and only a figure for each rule and batch is sent on."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    last = texts.select("h").distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return list(rules)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rejected, seconds = zip(*measured(b.column(0).to_pylist(), rules))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(rejected, pa.int64()), pa.array(seconds, pa.float64())], ["rule", "rejected", "seconds"])

    sample = texts.where(F.col("h") <= last).dropDuplicates(["h"]).select("text")
    figures = sample.mapInArrow(each, "rule int, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected"), F.sum("seconds")).collect()  # a row for each rule
    return by_gain(rules, [tuple(r[1:]) for r in sorted(figures)])


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def _judged(text: str | None, cascade: list[Rule]) -> tuple:
    d = Document(text)
    by = "base" if d.base_failed else first_rejection(d, cascade)
    return d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, by is None, by


def judge(docs: DataFrame, rules=RULES, sample_rows: int = 1000) -> DataFrame:
    """doc_id and JUDGED for each document (doc_id, text)."""
    cascade = ordered_on_sample(docs, rules, sample_rows)
    names = ["doc_id", *[c.split()[0] for c in JUDGED.split(", ")]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()]
        for b in batches:
            rows = [(i, *_judged(t.as_py(), cascade)) for i, t in zip(b.column(0).to_pylist(), b.column(1))]
            cols = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, " + JUDGED)


def keep_good(docs: DataFrame, rules=RULES, sample_rows: int = 1000) -> DataFrame:
    """docs that no rule rejects."""
    cascade = ordered_on_sample(docs, (*BASE, *rules), sample_rows)
    at = docs.columns.index("text")

    def good(text: str | None) -> bool:
        return first_rejection(Document(text), cascade) is None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([good(t.as_py()) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
g AS (SELECT doc_id, k, array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS win,
        count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM w),
t AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) > 1 AS again FROM g WHERE n = 8),
m AS (SELECT w.doc_id, w.k, coalesce(bool_or(t.again) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS inside FROM w LEFT JOIN t USING (doc_id, k)),
r AS (SELECT doc_id, count(*) FILTER (inside) AS n FROM m GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bang,
        len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS n_stutter
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        word_chars > 25 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR 2 * n_upper > word_chars OR 2 * n_letters < word_chars OR 4 * n_bang > n_words OR 10 * n_stutter > 3 * n_words AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM v
"""
