"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within ``radius`` r bits link. Each of the 64 bit positions gets a vector of r + 1 bits; the mask of a
nonzero vector v keeps the positions whose vector is not orthogonal to v. Up to r differing positions span at most r dimensions,
so some v is orthogonal to all of them: its mask leaves them out, and in its table both fingerprints have one key. So 2^(r+1) - 1
tables miss no pair, and every candidate is checked.

Documents with one fingerprint are one node from the start. Tables are swept in key order, in Arrow batches; of the links
within a bucket only a spanning forest leaves the task. A bucket with more than ``block`` fingerprints is split again: its mask's open bits are dealt into r + 1
parts, and fingerprints within r bits agree on one of them, so the buckets of the mask with each part added miss no pair. What is still larger
is cut into blocks which are compared pair by pair in tasks of their own, so no task holds more than two blocks. Components come from
large-star/small-star rounds, each written to the shared folder.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; texts may have any length, one text's words being held at a time beside a batch of whole texts; repeated rows are each returned; a null doc_id never names a component unless all in it are null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is set if it is set in over half the shingle hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    n = max(1, len(tokens) - words + 1)
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def masks(radius: int, seed: int = 5) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, as signed integers."""
    span = 2 ** (radius + 1) - 1
    vectors = [1 + k % span for k in range(BITS)]  # each about equally often, so that no mask keeps few bits
    random.Random(seed).shuffle(vectors)
    out = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, span + 1)]
    return [m - 2**64 if m >= 2**63 else m for m in out]


def finer(mask: int, radius: int) -> list[int]:
    """The mask with each of radius + 1 parts of its open bits added, as signed integers."""
    still = [i for i in range(BITS) if not mask >> i & 1]
    out = [mask | sum(1 << i for i in still[j :: radius + 1]) for j in range(radius + 1)]
    return [(m & (2**64 - 1)) - (2**64 if m >> 63 & 1 else 0) for m in out]


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, root) that join what is within radius, directly or by others."""
    seen, out = np.zeros(len(fps), dtype=bool), []
    u = fps.view(np.uint64)
    for root in range(len(fps)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            at, rest = front.pop(), np.flatnonzero(~seen)
            near = rest[np.bitwise_count(u[rest] ^ u[at]) <= radius]
            seen[near] = True
            front.extend(near.tolist())
            out += [(int(fps[k]), int(fps[root])) for k in near]
    return out


def _last(rows: np.ndarray) -> int:
    """Where the last bucket begins."""
    other = np.flatnonzero((rows[:, :2] != rows[-1:, :2]).any(axis=1))
    return int(other[-1]) + 1 if len(other) else 0


def _links(rows: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Of whole buckets, in order."""
    cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
    two = starts[stops - starts == 2]
    a, b = rows[two, 2], rows[two + 1, 2]
    near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
    yield from zip(a[near].tolist(), b[near].tolist())
    more = stops - starts > 2
    for s, e in zip(starts[more].tolist(), stops[more].tolist()):
        yield from forest(np.ascontiguousarray(rows[s:e, 2]), radius)


SWEPT = "mask long, key long, a long, b long, part long"


def _sweep(batches: Iterator[pa.RecordBatch], radius: int, block: int) -> Iterator[pa.RecordBatch]:
    """From (mask, key, fp) in order: links (a, b), and the members (mask, key, a, part) of buckets over a block."""

    def batch(links, members=()):
        rows = [(None, None, a, b, None) for a, b in links] + [(m, k, f, None, p) for m, k, f, p in members]
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["mask", "key", "a", "b", "part"])

    def blocked(rows, part):
        return batch(forest(np.ascontiguousarray(rows[:, 2]), radius), [(*r, part) for r in rows.tolist()])

    carry, large, part = np.empty((0, 3), dtype=np.int64), None, 0
    for b in batches:
        rows = np.concatenate([carry, np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]).astype(np.int64)])
        if not len(rows):
            continue
        first, last = 0, _last(rows)
        if large is not None:
            same = (rows[:, :2] == large).all(axis=1)
            first = len(rows) if same.all() else int(np.argmin(same))
            if first == len(rows):
                first = 0
            else:
                if first:
                    yield blocked(rows[:first], part)
                large = None
        if first < last:
            yield batch(_links(rows[first:last], radius))
        carry = rows[last:]
        part = part if large is not None else 0
        while len(carry) > block:
            large = carry[0, :2].copy()
            yield blocked(carry[:block], part)
            carry, part = carry[block:], part + 1
    if len(carry):
        yield batch(_links(carry, radius)) if large is None else blocked(carry, part)


def _swept(keyed: DataFrame, radius: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """keyed: (mask, key, fp). Links (a, b) within blocks, and the members (mask, key, fp, part) of buckets of several blocks, if there are any."""
    keyed = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    swept = stored(keyed.mapInArrow(lambda it: _sweep(it, radius, block), SWEPT), "buckets")
    inner = swept.where(F.col("b").isNotNull()).select("a", "b")
    if swept.where("part > 0").isEmpty():
        return inner, None
    members = swept.where(F.col("part").isNotNull()).select("mask", "key", F.col("a").alias("fp"), "part")
    return inner, members.join(members.groupBy("mask", "key").agg(F.max("part").alias("top")).where("top > 0"), ["mask", "key"])


def links(fps: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """fps: distinct (fp). Links (a, b), a > b, that connect all fingerprints within radius of each other."""
    first = masks(radius)
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(first)]))
    found, members = _swept(fps.select("fp", each.alias("t")).select("t.mask", "t.key", "fp"), radius, block)
    if members is not None:
        second = F.array(*[F.array(*[F.lit(m) for m in finer(m, radius)]) for m in first])
        again = members.select("mask", "fp", F.posexplode(F.get(second, F.col("mask").cast("int"))).alias("j", "m"))
        more, members = _swept(again.select((F.col("mask") * (radius + 1) + F.col("j")).alias("mask"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp"), radius, block)
        found = found.unionByName(more)
    if members is not None:
        pairs = members.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top")))).where("q <> part")
        pairs = pairs.select("mask", "key", F.least("part", "q").alias("lo"), F.greatest("part", "q").alias("hi"), "fp")
        across = pairs.groupBy("mask", "key", "lo", "hi").applyInArrow(
            lambda t: pa.Table.from_pylist([{"a": a, "b": b} for a, b in forest(t.column("fp").to_numpy(), radius)], pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long"
        )
        found = found.unionByName(across)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), a > b. (node, root): the smallest node that each reaches; large-star and small-star in turn until nothing changes."""
    edges = stored(edges, "edges")
    was = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b")
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _named(fps: DataFrame, radius: int, block: int) -> DataFrame:
    """fps: (doc_id, fp, ...). fp, root, component_id of each fingerprint."""
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius, block))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id of each document (doc_id, text)."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    return fps.join(_named(fps, radius, block).drop("root"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, block: int = 4096) -> DataFrame:
    """docs without near-duplicates: of each component one row, that with the least (doc_id, fingerprint, hash of the text), null ids last.

    Rows that agree in all three are copies, of which any stays. Ids need not be unique, and rows without an id are told apart by their texts.
    """
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    schema = "doc_id long, fp long, h long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (fps,) = _fingerprints(iter([b]), words)
            yield pa.RecordBatch.from_arrays([fps.column(0), fps.column(1), b.column(2)], ["doc_id", "fp", "h"])

    fps = stored(rows.mapInArrow(each, schema), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h")
    kept = fps.join(_named(fps, radius, block), "fp").groupBy("root").agg(F.min(key).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__pl_id"), F.col("k.h").alias("__pl_h")).distinct()
    same = id_.eqNullSafe(F.col("__pl_id")) & (F.xxhash64(text) == F.col("__pl_h"))
    return docs.join(kept, same).dropDuplicates(["__pl_id", "__pl_h"]).drop("__pl_id", "__pl_h")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
