"""Vector code compression: four codebooks of 256 integer entries, found by Lloyd rounds whose nearest entries come from segment-mean lower bounds.

A part of a vector is cut into 1, then 4, then 16, ... equal segments. The squared distance of two parts is that of their segment means (weighted by
width) plus that of what is left beside the means, and the latter is at least the squared difference of the residual norms. So each
level gives a lower bound, finer ones a larger one. Entries whose bound passes the distance to a known entry are out, by a margin above the rounding error of
the bound; the survivors of the last level receive exact integer distances, so the nearest entry is exact, ties to the lower index.

Rounds run on Spark: each task sums its parts by entry, the sums of all tasks are added up by a shuffle, and the driver holds the codebooks alone (4 x 256 entries).

Defined cases: vectors that are null or hold null or non-finite components are left out; shorter vectors go on with zeros up to the longest
length, rounded up to a multiple of four; components beyond +-16384 count as that, so that squares fit 64 bits; equal and null ids are ordered by id (null last), then by vector;
fewer than 256 vectors give that many entries; repeated rows are each returned; an empty table gives an empty result; other columns are ignored. A vector of any
length is held whole in a task, several thousand at a time in batches of Arrow's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, stored, table

PARTS, SCALE, FARTHEST = 4, 1024, 16384
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def usable(vector: str | Column) -> Column:
    """Neither null nor with null or non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of float64, continued with zeros up to width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) == len(lengths) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(np.clip(matrix(column, width), -FARTHEST, FARTHEST) * SCALE).astype(np.int64)


@dataclass
class Segments:
    """One level of a set of parts: segment sums over root of width, and bounds of the residual norm."""

    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, parts: np.ndarray, count: int) -> Segments:
        edges = np.arange(count + 1) * parts.shape[1] // count
        sums = np.add.reduceat(parts, edges[:-1], axis=1) / np.sqrt(np.diff(edges))
        squares = (parts * parts).sum(axis=1).astype(np.float64)
        rest, slack = squares - (sums * sums).sum(axis=1), 1e-13 * squares  # the slack is far above the rounding of either sum
        return cls(sums, np.sqrt(np.maximum(rest - slack, 0)), np.sqrt(np.maximum(rest + slack, 0)))


def levels(width: int) -> list[int]:
    out, count = [], 1
    while count < width:
        out.append(count)
        count *= 4
    return out


def _bound(x: Segments, y: Segments, i: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance of x[i] and y[e]."""
    gap = np.maximum(np.maximum(x.low[i] - y.high[e], y.low[e] - x.high[i]), 0)
    out = gap * gap
    for s in range(x.sums.shape[1]):
        d = x.sums[i, s] - y.sums[e, s]
        out += d * d
    return out * (1 - 1e-12)


def nearest(parts: np.ndarray, entries: np.ndarray, steps: list[Segments], rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each part. steps: the entries' segments at each of levels()."""
    n, k = len(parts), len(entries)
    index, error = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for at in range(0, n, rows):
        x = parts[at : at + rows]
        m, everyone = len(x), np.arange(len(x))
        if steps:
            first = Segments.of(x, 1)
            bounds = _bound(first, steps[0], everyone[:, None], np.arange(k)[None, :])
            best = bounds.argmin(axis=1)
            upper = ((x - entries[best]) ** 2).sum(axis=1)
            i, e = np.nonzero(bounds <= upper[:, None])
        else:
            i, e = np.repeat(everyone, k), np.tile(np.arange(k), m)
        for step in steps[1:]:
            bounds = _bound(Segments.of(x, step.sums.shape[1]), step, i, e)
            starts = np.searchsorted(i, everyone)
            least = np.minimum.reduceat(bounds, starts)
            best = np.minimum.reduceat(np.where(bounds == least[i], e, k), starts)
            upper = np.minimum(upper, ((x - entries[best]) ** 2).sum(axis=1))
            keep = bounds <= upper[i]
            i, e = i[keep], e[keep]
        starts = np.searchsorted(i, everyone)
        exact = ((x[i] - entries[e]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(exact, starts)
        index[at : at + m] = np.minimum.reduceat(np.where(exact == least[i], e, k), starts)
        error[at : at + m] = least
    return index, error


@dataclass
class Codebooks:
    """entries: part x entry x position."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        self.steps = [[Segments.of(book, c) for c in levels(book.shape[1])] for book in self.entries]

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and squared distances, row x part."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        found = [nearest(np.ascontiguousarray(cut[:, p]), book, self.steps[p]) for p, book in enumerate(self.entries)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    parts, k, width = books.entries.shape
    sums, counts = np.zeros((parts, k, width), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
    for b in batches:
        if not len(b):
            continue
        vectors = integers(b.column(0), books.width)
        index, _ = books.assign(vectors)
        cut = vectors.reshape(len(vectors), parts, width)
        for p in range(parts):
            order = np.argsort(index[:, p], kind="stable")
            used, starts = np.unique(index[order, p], return_index=True)
            sums[p, used] += np.add.reduceat(cut[order, p], starts, axis=0)
            counts[p] += np.bincount(index[:, p], minlength=k)
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), *(pa.array(sums[p, e, j]) for j in range(width))], ["part", "entry", "n", *(f"s{j}" for j in range(width))])


def refined(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One Lloyd round: each entry becomes the floored mean of the parts nearest to it; unused entries stay."""
    parts, k, width = books.entries.shape
    names = [f"s{j}" for j in range(width)]
    rows = kept.select("embedding").mapInArrow(lambda it: _sums(it, books), ", ".join(f"{c} long" for c in ["part", "entry", "n", *names]))
    entries = books.entries.copy()
    for r in rows.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *names])).collect():  # at most parts x entries rows
        entries[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    return Codebooks(entries)


def first_entries(kept: DataFrame, width: int, size: int) -> Codebooks | None:
    """The parts of the vectors with the least ids. Ids are looked at alone first, so that few vectors move."""
    ids = [r[0] for r in kept.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(size).collect()]
    if not ids:
        return None
    rows = kept if len(ids) < size or ids[-1] is None else kept.where(F.col("vec_id") <= ids[-1])
    chosen = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(size).collect()
    vectors = integers(pa.array([r["embedding"] for r in chosen], pa.list_(pa.float64())), width)
    return Codebooks(np.ascontiguousarray(vectors.reshape(len(vectors), PARTS, -1).transpose(1, 0, 2)))


def _coded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            index, error = books.assign(integers(b.column(2), books.width))
            codes = [bytes(r).hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes), pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])


def compress(rows: DataFrame, size: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """rows: (vec_id, embedding, label). vec_id, label (as text), code, error of each usable vector, and the codebooks. size: at most 256."""
    kept = rows.where(usable("embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0]
    width = max(PARTS, -(-(longest or 0) // PARTS) * PARTS)
    books = None if longest is None else first_entries(kept, width, size)
    schema = "vec_id long, label string, code string, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema), None
    for _ in range(rounds):
        books = refined(kept, books)
    final = books
    coded = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").mapInArrow(lambda it: _coded(it, final), schema)
    return stored(coded, "codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    if books is None:
        return spark.createDataFrame([], SCHEMA)
    keyed = coded.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("of"))
    sums = stored(keyed.groupBy("none", "of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    out = hot_join(keyed, sums, ["none", "of"], "n", sums.agg(F.sum("n")).first()[0] or 0)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(rounds: int = 4, size: int = 256) -> str:
    """Part rows are lists; each round finds every nearest entry by brute force."""
    near = """near{r} AS MATERIALIZED (
  SELECT p.id, p.part, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.entry}}) AS m
  FROM parts p JOIN book{r} b ON p.part = b.part GROUP BY p.id, p.part)"""
    book = """book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(s ORDER BY pos) AS x FROM (
      SELECT n.part, n.m.e AS entry, g.pos, floor(sum(p.x[g.pos])::DOUBLE / count(*))::BIGINT AS s
      FROM near{r} n JOIN parts p ON p.id = n.id AND p.part = n.part, (SELECT unnest(range(1, (SELECT any_value(len(x)) FROM parts) + 1)) AS pos) g
      GROUP BY ALL) GROUP BY part, entry) u ON u.part = b.part AND u.entry = b.entry)"""
    steps = []
    for r in range(rounds):
        steps += [near.format(r=r), book.format(r=r, n=r + 1)]
    steps.append(near.format(r=rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p.part, v[p.part * (len(v) // 4) + 1 : (p.part + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS part) p),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x FROM parts WHERE id <= {size}),
{", ".join(steps)},
whole AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}),
coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(hex(n.m.e)), 2, '0'), '' ORDER BY n.part) AS code, sum(n.m.d)::BIGINT AS error
  FROM kept k JOIN near{rounds} n USING (id) GROUP BY k.id, k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, whole
"""


ORACLE = _oracle()
