"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosine.

Vectors of cosine c or more are, at unit length, at most r = sqrt(2 - 2c) apart. Every unit vector goes to the list of its nearest coarse centroid, and what
it differs from the centroid by is stored as codes: per subspace the nearest of 256 residual codewords, with the norm of what the codes leave out (its loss).

* Probes are sufficient: a vector searches each list that can hold anything within r, that is each whose boundary with its own list is at most
  r away: (d(x,c)^2 - d(x,own)^2) / (2 d(c,own)) <= r. Of two lists the one with the smaller number searches.
* Asymmetric distances from tables of the searching vector's subspace distances bound the true ones: a code whose distance is over r plus its loss is out.
* What is left gets the exact cosine in double precision.

So no pair is lost, whatever the sample; a poor sample only costs time. Centroids and codewords are fitted on a hash sample of about ``sample_rows`` distinct vectors (twice that
at most) by the driver; all vectors are indexed. Equal vectors are one node from the start. Lists and what searches them are dealt into parts of about ``block`` rows, and
a task compares two parts; of the pairs it finds, only counts and a spanning forest leave it. Components come from large-star/small-star rounds.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component; shorter vectors go on with zeros; repeated rows and ids are each returned, equal vectors
linked; a null vec_id never names a component unless all in it are null, and counts as kept only then; an empty table gives an empty result; other columns are ignored. A vector of any length is held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, stored, table
from .simhash import components
from .vector_codes import matrix, usable

#: Room for float32 rounding of distances of unit vectors.
SLACK = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, first by a power of two, so that no square overflows or vanishes."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = np.ldexp(vectors, -np.frexp(largest)[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)


def means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd rounds from evenly spaced points; empty clusters stay where they are."""
    centres = points[np.arange(k) * len(points) // k].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(points[at : at + 4096], centres).argmin(axis=1) for at in range(0, len(points), 4096)])
        order = np.argsort(near, kind="stable")
        used, starts, counts = np.unique(near[order], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(points[order], starts, axis=0) / counts[:, None]
    return centres


@dataclass
class Index:
    """Coarse centroids (list x width) and residual codewords (subspace x code x width / subspaces), both float32. real: the type of packed components."""

    centroids: np.ndarray
    words: np.ndarray
    real: str

    @classmethod
    def fitted(cls, points: np.ndarray, lists: int, subspaces: int, real: str, codes: int = 256) -> Index:
        centroids = means(points, min(lists, len(points)))
        rest = points - centroids[squared(points, centroids).argmin(axis=1)]
        cut = rest.reshape(len(rest), subspaces, -1)
        words = np.stack([means(np.ascontiguousarray(cut[:, s]), min(codes, len(rest))) for s in range(subspaces)])
        return cls(centroids.astype(np.float32), words.astype(np.float32), real)

    def coded(self, points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, loss of each point, and the lists of larger number that it searches."""
        to = squared(points, self.centroids.astype(np.float64))
        own = to.argmin(axis=1)
        cut = (points - self.centroids[own]).reshape(len(points), len(self.words), -1)
        codes, loss = np.empty((len(points), len(self.words)), dtype=np.uint8), np.zeros(len(points))
        for s, words in enumerate(self.words.astype(np.float64)):
            d = squared(np.ascontiguousarray(cut[:, s]), words)
            codes[:, s] = d.argmin(axis=1)
            loss += d.min(axis=1)
        apart = np.sqrt(squared(self.centroids.astype(np.float64), self.centroids.astype(np.float64)))[own]
        margin = to - to[np.arange(len(points)), own][:, None]
        hits = (margin <= 2 * (radius + SLACK) * apart + SLACK) & (np.arange(len(self.centroids))[None, :] > own[:, None])
        return own, codes, np.sqrt(loss), [np.flatnonzero(h) for h in hits]


def _packed(batches: Iterator[pa.RecordBatch], width: int, real: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = matrix(b.column(1), width).astype(real)
        keep = np.abs(rows).max(axis=1, initial=0) > 0
        packed = [r.tobytes() if k else None for r, k in zip(rows, keep)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["vec_id", "packed"])


def unpacked(packed: list[bytes], real: str) -> np.ndarray:
    """Unit vectors of at least one row."""
    return unit(np.frombuffer(b"".join(map(bytes, packed)), dtype=real).reshape(len(packed), -1).astype(np.float64))


INDEXED = "node long, w long, packed binary, codes binary, loss float, list int, probes array<int>"


def _indexed(batches: Iterator[pa.RecordBatch], index: Index, radius: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            own, codes, loss, probes = index.coded(unpacked(b.column(2).to_pylist(), index.real), radius)
            columns = [b.column(0), b.column(1), b.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(loss.astype(np.float32)), pa.array(own.astype(np.int32)), pa.array(probes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "w", "packed", "codes", "loss", "list", "probes"])


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.up[a], self.up[b]], axis=1), axis=0)
        while len(pairs := pairs[pairs[:, 0] != pairs[:, 1]]):
            low, high = pairs.min(axis=1), pairs.max(axis=1)
            np.minimum.at(self.up, high, low)
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
            pairs = np.unique(self.up[pairs], axis=0)


def close_pairs(index: Index, list_: int, searching: dict, members: dict, cosine: float, same: bool, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in searching, in members) of pairs of at least that cosine; for one part searching itself, each pair once."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    x, codes = searching["unit"], members["codes"].T
    rest = (x - index.centroids[list_]).astype(np.float32).reshape(len(x), len(index.words), -1)
    limit = (radius + members["loss"]) ** 2
    for at in range(0, len(x), rows):
        tables = [squared(words, np.ascontiguousarray(rest[at : at + rows, s])) for s, words in enumerate(index.words)]
        far = tables[0][codes[0]]
        for t, c in zip(tables[1:], codes[1:]):
            far += t[c]
        j, i = np.nonzero(far <= limit[:, None] + SLACK)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), 1 << 15):
            a, b = i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
            near = np.einsum("ij,ij->i", x[a], members["unit"][b]) >= cosine
            if near.any():
                yield a[near], b[near]


FOUND = "node long, n long, other long"


def _compared(group: pa.Table, index: Index, cosine: float) -> pa.Table:
    """group: rows of two parts, role 0 the members, role 1 what searches (none: the members search themselves). Links of each row, counted, and one row that it hangs together with."""
    roles = group.column("role").to_numpy()
    sides = []
    for role in (0, 1):
        t = group.filter(pa.array(roles == role))
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.uint8).reshape(len(t), len(index.words))
        sides.append({"node": t.column("node").to_numpy(), "w": t.column("w").to_numpy(), "unit": unpacked(t.column("packed").to_pylist(), index.real) if len(t) else np.empty((0, index.centroids.shape[1])), "codes": codes, "loss": t.column("loss").to_numpy()})
    members, searching = sides
    same = group.column("same")[0].as_py()
    if same:
        searching = members
    nodes = members["node"] if same else np.concatenate([searching["node"], members["node"]])
    shift = 0 if same else len(searching["node"])
    counts, forest = np.zeros(len(nodes), dtype=np.int64), Forest(len(nodes))
    for a, b in close_pairs(index, group.column("list")[0].as_py(), searching, members, cosine, same):
        np.add.at(counts, a, members["w"][b])
        np.add.at(counts, b + shift, searching["w"][a])
        forest.join(a, b + shift)
    used = np.flatnonzero(counts)
    return pa.table({"node": pa.array(nodes[used], pa.int64()), "n": pa.array(counts[used], pa.int64()), "other": pa.array(nodes[forest.up[used]], pa.int64())})


def links(nodes: DataFrame, index: Index, cosine: float, block: int) -> DataFrame:
    """nodes: (node, w, packed). (node, n, other): partial weighted numbers of links, and links that connect all components."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = stored(nodes.select("node", "w", "packed").mapInArrow(lambda it: _indexed(it, index, radius), INDEXED), "inverted-lists")
    base = ["node", "w", "packed", "codes", "loss"]
    sizes = {r[0]: r[1] for r in rows.groupBy("list").count().collect()}  # at most a row for each centroid
    asking = {r[0]: r[1] for r in rows.select(F.explode("probes").alias("list")).groupBy("list").count().collect()}
    lists = range(len(index.centroids))
    parts = F.array(*(F.lit(-(-sizes.get(k, 0) // block)) for k in lists))
    asked = F.array(*(F.lit(-(-asking.get(k, 0) // block)) for k in lists))
    n, q = F.get(parts, F.col("list")), F.get(asked, F.col("list"))
    place = F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    held = rows.select(*base, "list", place.alias("p"), n.alias("n"), q.alias("q"))
    among = held.select(*base, "list", "p", F.explode(upto(F.col("n"))).alias("other"))
    within = among.select(*base, "list", (F.col("p") == F.col("other")).alias("same"), F.greatest("p", "other").alias("p"), F.least("p", "other").alias("o"), F.when(F.col("p") >= F.col("other"), 0).otherwise(1).alias("role"))
    member = held.select(*base, "list", F.lit(False).alias("same"), "p", F.explode(upto(F.col("q"))).alias("k")).select(*base, "list", "same", "p", (-1 - F.col("k")).alias("o"), F.lit(0).alias("role"))
    search = rows.select(*base, F.explode("probes").alias("list")).withColumns({"n": n, "q": q})
    search = search.select(*base, "list", F.lit(False).alias("same"), F.explode(upto(F.col("n"))).alias("p"), (-1 - F.pmod(F.xxhash64("node"), F.greatest("q", F.lit(1))).cast("int")).alias("o"), F.lit(1).alias("role"))
    every = within.unionByName(member).unionByName(search)
    return every.groupBy("list", "p", "o").applyInArrow(lambda t: _compared(t, index, cosine), FOUND)


def fitted(nodes: DataFrame, count: int, width: int, real: str, sample_rows: int, list_rows: int, most_lists: int) -> Index:
    sample_rows = min(sample_rows, max(256, (1 << 25) // width))
    share = min(1.0, sample_rows / count)
    chosen = nodes.select("packed").where(F.pmod(F.xxhash64("packed"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * sample_rows)
    packed = sorted(bytes(r[0]) for r in chosen.union(nodes.select("packed").limit(1)).distinct().collect())  # about sample_rows, and one at least
    return Index.fitted(unpacked(packed, real), max(1, min(most_lists, count // list_rows)), width // 8, real)


def near_vectors(rows: DataFrame, cosine: float = 0.95, sample_rows: int = 16_384, list_rows: int = 4096, most_lists: int = 1024, block: int = 2048) -> DataFrame:
    """rows: (vec_id, embedding). vec_id, n_links, component_id, kept."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable("embedding"), F.col("embedding")).alias("embedding"))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width, real = max(8, -(-longest // 8) * 8), "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    given = rows.select("vec_id", F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("embedding"))
    packed = stored(given.mapInArrow(lambda it: _packed(it, width, real), "vec_id long, packed binary"), "vectors")
    nodes = packed.where(F.col("packed").isNotNull()).groupBy("packed").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    count, total = nodes.agg(F.count(F.lit(1)), F.sum("w")).first()
    alone = packed.where(F.col("packed").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if count:
        found = stored(links(nodes, fitted(nodes, count, width, real, sample_rows, list_rows, most_lists), cosine, block), "links")
        edges = found.where("node <> other").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        linked = found.groupBy("node").agg(F.sum("n").alias("n")).join(components(edges), "node", "left")
        nodes = stored(nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        least = nodes.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
        named = hot_join(nodes.select("root", "packed", "w", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), least, ["root"], "size", count)
        alone = alone.unionByName(hot_join(packed, named, ["packed"], "w", total).select("vec_id", "n_links", "component_id"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS x, b.id AS y, b.vec_id AS other FROM usable a JOIN usable b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT id AS x, id AS y FROM usable UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
component AS (SELECT r.x AS id, min(u.vec_id) AS component_id FROM reach r JOIN usable u ON u.id = r.y GROUP BY r.x),
counted AS (SELECT x AS id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM (
  SELECT u.vec_id, coalesce(c.n_links, 0) AS n_links, k.component_id FROM usable u JOIN component k USING (id) LEFT JOIN counted c USING (id)
  UNION ALL SELECT vec_id, 0, vec_id FROM embeddings
  WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
"""
