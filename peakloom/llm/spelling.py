"""Spelling variants by a self-join of the vocabulary's trie with active-node sets.

Two words at distance one agree before the edit and behind it, so of the shorter one's m code points at least m // 2 agree at the front or at
the end. The trie is therefore partitioned by prefixes of half a word, and a second one, of the words read backwards, likewise: a word
takes part with its own length and with the next smaller one, in both directions. In a partition the trie is walked once, and each node hands
its children the nodes at distance one of it: a node's own parent (a code point more), the children beside it (another code point), and what the handed nodes lead to
by the same code point. Words that end at such a pair of nodes are near. The backward trie leaves out what the forward one has, so each
pair is met once, and a task keeps for each word a count and the best partner only.

A partition of more than ``block`` code points is split again by the same rule within the part that is still open, which halves each time down to one code
point. So no task builds a larger trie, and partitions that hold a large share of all words are split before they are shuffled.

Defined cases: null and empty texts have no words; a null doc_id counts as empty text in front of the colon; repeated rows count each; a run of one code point may lose it; words and texts
may have any length (a task holds a batch of whole texts and a table of its distinct words, passed on at ``most`` words); ties go to the smaller word in code-point order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, hot_join, stored, table

#: In UTF-8, U+00C0 to U+00FF are C3 and one byte from 80 to BF. All other lead bytes, with what follows them, part words.
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]*")
_SPACED = bytes(b if 97 <= b <= 122 or 128 <= b <= 191 or b == 0xC3 else 32 for b in range(256))


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, A-Z lower-cased."""
    text = text.lower()  # of bytes: A-Z only
    return (text if text.isascii() else _OTHER.sub(b" ", text)).translate(_SPACED).split()


def slipped(run: bytes, h: int) -> str:
    word = run.decode("utf-8")
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], rate: int, most: int) -> Iterator[pa.RecordBatch]:
    """Partial (word, n)."""
    crc = zlib.crc32
    counts: Counter[bytes] = Counter()
    slips: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        words, ns = [w.decode("utf-8") for w in counts] + list(slips), [*counts.values(), *slips.values()]
        counts.clear()
        slips.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = runs(text or b"")
            counts.update(found)
            start = crc(b":" if doc_id is None else b"%d:" % doc_id)
            if hit := [w for w in set(found) if not crc(w, start) % rate]:
                times = Counter(found)
                for run in hit:
                    counts[run] -= times[run]
                    slips[slipped(run, crc(run, start))] += times[run]
            if len(counts) > most:
                yield batch()
    yield batch()


def vocabulary(docs: DataFrame, rate: int = 97, least_length: int = 5, least_n: int = 3, most: int = 300_000) -> DataFrame:
    """(word, n) of docs (doc_id, text). Every rate-th run of a document, by its hash, loses a code point."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = texts.mapInArrow(lambda it: _counted(it, rate, most), "word string, n long")
    return rows.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def placed(words: DataFrame, least_length: int) -> DataFrame:
    """words (word, n) as members of partitions. Pairs of a partition have a shorter word of m code points and agree on the first a and the last b."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    return narrowed(words.select("word", "n", m).where(F.col("m") >= least_length).select("m", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(-1).alias("cut"), "word", "n"))


def narrowed(rows: DataFrame) -> DataFrame:
    """(key, word, n) from (m, a, b, cut, word, n): each row twice, with half of its open code points fixed as well, at the front or at the end.

    Words that agree on their first ``cut`` code points (-1: none) are met by a forward trie elsewhere. Those at the end leave out what agrees on the half in front, which
    their own later parts then leave out as well. The key begins with m, direction, a, b and cut.
    """
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    rows = rows.select("m", "a", "b", "cut", "word", "n", half.alias("half"), F.explode(F.array(F.lit(1), F.lit(0))).alias("front"))
    a, b = F.col("a") + F.col("half") * F.col("front"), F.col("b") + F.col("half") * (1 - F.col("front"))
    own = F.col("a") + F.col("half")
    cut = F.when(F.col("front") == 1, F.col("cut")).when(F.col("cut") < 0, own).otherwise(F.least(own, "cut"))
    rows = rows.select("m", "front", a.alias("a"), b.alias("b"), cut.alias("cut"), "word", "n")
    start, end = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))
    return rows.select(F.concat_ws(" ", "m", "front", "a", "b", "cut", start, end).alias("key"), "word", "n")


def _numbers(key: str) -> list[int]:
    """m, front, a, b, cut."""
    return [int(x) for x in key.split(" ", 5)[:5]]


def near_pairs(opens: list[str], shorter: int) -> Iterator[tuple[int, int]]:
    """Places of texts at distance one, each pair once, of which one at least has ``shorter`` code points. opens: distinct, of shorter or shorter + 1 code points."""
    root: dict = {}
    for k, text in enumerate(opens):
        node = root
        for c in text:
            node = node.setdefault(c, {})
        node[""] = k
    stack: list[tuple[dict, int, list, list]] = [(root, 0, [], [])]
    while stack:
        node, depth, less, other = stack.pop()  # less: nodes that leave out one code point of this one's; other: nodes with another one in its place
        here = node.get("")
        if here is not None:
            yield from ((here, v[""]) for v in (less if depth > shorter else other) if "" in v)
        children = [x for x in node.items() if x[0]]
        for k, (c, child) in enumerate(children):
            fewer = [w for v in less if (w := v.get(c)) is not None and w is not node]  # of a run of one code point, any may be left out: one node
            fewer.append(node)
            changed = [w for v in other if (w := v.get(c)) is not None]
            changed += [w for _, w in children[k + 1 :]]
            stack.append((child, depth + 1, fewer, changed))


def _partners(key: str, members: list[tuple[str, int]]) -> Iterator[tuple]:
    """word, number of its near words here, n of the best of them, the best."""
    m, front, a, b, cut = _numbers(key)
    opens = [w[a : len(w) - b] for w, _ in members]
    best: dict[int, list] = {}
    for i, j in near_pairs(opens if front else [x[::-1] for x in opens], m - a - b):
        if cut >= 0 and members[i][0][:cut] == members[j][0][:cut]:
            continue
        for x, y in ((i, j), (j, i)):
            word, n = members[y]
            mine = best.setdefault(x, [0, (-n, word)])
            mine[0] += 1
            mine[1] = min(mine[1], (-n, word))
    return ((members[x][0], count, -n, word) for x, (count, (n, word)) in best.items())


SWEPT = "word string, near long, best_n long, best string, key string, n long"


def _sweep(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """From (key, word, n) in order of keys: partners, and the members of partitions over block, with their key."""
    rows: list[tuple] = []
    last, members, chars, over = "", [], 0, False
    m = a = b = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        rows.clear()
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "near", "best_n", "best", "key", "n"])

    def finish() -> None:
        if over:
            rows.extend((w, None, None, None, last, n) for w, n in members)
        elif len(members) > 1:
            rows.extend((*x, None, None) for x in _partners(last, members))

    for record in batches:
        for key, word, n in zip(*(c.to_pylist() for c in record.columns)):
            if key != last:
                finish()
                last, members, chars, over = key, [], 0, False
                m, _, a, b, _ = _numbers(key)
            members.append((word, n))
            chars += len(word) - a - b
            if chars > block and m - a - b > 1:
                over = True
                finish()
                members = []
            if len(rows) > 20_000:
                yield batch()
    finish()
    yield batch()


def partners(words: DataFrame, least_length: int = 5, block: int = 200_000) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n), stored, that have near words."""
    least_hot = max(block, 4 * (words.agg(F.sum(F.length("word"))).first()[0] or 0) // HOT)  # of larger partitions there are fewer than HOT
    rows, found = placed(words, least_length), []
    while rows is not None:
        open_ = F.length("word") - F.split("key", " ")[2].cast("int") - F.split("key", " ")[3].cast("int")
        left = F.split("key", " ")[0].cast("int") - F.split("key", " ")[2].cast("int") - F.split("key", " ")[3].cast("int")
        hot = stored(rows.groupBy("key").agg(F.sum(open_).alias("chars")).where((F.col("chars") > least_hot) & (left > 1)).select("key"), "hot-prefixes")
        cold = rows.join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key")
        swept = stored(cold.mapInArrow(lambda it: _sweep(it, block), SWEPT), "variants")
        found.append(swept.where(F.col("key").isNull()).select("word", "near", "best_n", "best"))
        again = swept.where(F.col("key").isNotNull()).select("key", "word", "n").unionByName(rows.join(F.broadcast(hot), "key"))
        part = F.split("key", " ")
        again = again.select(part[0].cast("int").alias("m"), part[2].cast("int").alias("a"), part[3].cast("int").alias("b"), part[4].cast("int").alias("cut"), "word", "n")
        rows = None if again.isEmpty() else narrowed(again)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame, total: int) -> DataFrame:
    """(word, root) of forms (word, form): what following forms leads to at last. A form occurs at least twice as often as its word, so chains are short and jumps double them."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next")).join(at.groupBy("root").agg(F.count(F.lit(1)).alias("pointing")), "root")
        jumped = stored(hot_join(at, onward, ["root"], "pointing", total, how="left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, rate: int = 97, least_length: int = 5, least_n: int = 3, factor: int = 2, block: int = 200_000) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (doc_id, text)."""
    words = stored(vocabulary(docs, rate, least_length, least_n), "vocabulary")
    near = words.join(partners(words, least_length, block), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    last = roots(near.where(F.col("form").isNotNull()), near.count())
    return near.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
hashed AS MATERIALIZED (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc),
words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS MATERIALIZED (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places),
pairs AS MATERIALIZED (
  SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.head || c.tail = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.head || c.tail = w.word),
near AS MATERIALIZED (
  SELECT p.x AS word, count(*) AS n_near, min({'n': -w.n, 'w': w.word}) AS best FROM pairs p JOIN words w ON w.word = p.y GROUP BY p.x),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN -m.best.n >= 2 * w.n THEN m.best.w END AS form, CASE WHEN -m.best.n >= 2 * w.n THEN -m.best.n END AS form_n
  FROM words w LEFT JOIN near m ON m.word = w.word),
chain AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON e.word = f.word
"""
