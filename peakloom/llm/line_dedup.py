"""Line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches, the largest ids first. A run is a table bucketed and sorted by line hash, so runs and batches merge bucket by
bucket without an exchange of the runs. A batch is merged against the runs of the earlier batches: a hash that none has entered (the anti join) enters the batch's run
with its keeper, the largest doc_id that has the line; a hash already entered leaves only its counts there. So each hash has one entry over all runs.
Whenever a level holds ``fanout`` runs, they are compacted into one run of the next level, which adds counts to entries; at last all runs are.
Lines then look up their entry: those of hashes with enough documents go, except in the keeper. Hashes that a large share of all lines have, boundedly
many, are looked up by broadcast.

Defined cases: a null or empty text is one empty line; lines under ``min_chars`` code points are never dropped;
several rows with one doc_id count as one document, and all of them keep the lines that doc_id keeps; rows with a
null doc_id count as one document smaller than any other; texts may have any length, each held
whole as one row while it is split and joined again; an empty table gives an empty result. Columns beside
doc_id and text are ignored (``dedup_lines``) or passed through (``drop_lines``); names beginning with ``__pl_`` are reserved. The session
needs a catalog that tables can be written to; tables of a run that failed stay in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, hot_join, new_path, stored, table, text_of

#: Stands for a null doc_id while ids are compared.
NO_ID = -(2**63)


class LineRuns:
    """Levelled sorted runs of (h1, h2, keeper, n_docs, n_rows): bucketed tables in the shared folder. A row without a keeper adds its counts to the
    entry of an earlier run."""

    KEYS = ["h1", "h2"]

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as a batch's partitions

    def _write(self, rows: DataFrame) -> str:
        name = f"peakloom_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, *self.KEYS).sortBy(*self.KEYS).option("path", new_path(self.spark, "run")).saveAsTable(name)
        return name

    def _all(self) -> list[str]:
        """Oldest first."""
        return [run for level in reversed(self.levels) for run in level]

    def marked(self, batch: DataFrame) -> DataFrame:
        """batch (h1, h2, top, n_docs, n_rows) with keeper: top where no run has the hash entered."""
        held = F.lit(False)
        for k, run in enumerate(self._all()):
            entries = self.spark.table(run).where(F.col("keeper").isNotNull()).select(*self.KEYS, F.lit(True).alias(f"held{k}"))
            batch = batch.join(entries.hint("merge"), self.KEYS, "left")
            held = held | F.col(f"held{k}").isNotNull()
        return batch.select(*self.KEYS, F.when(~held, F.col("top")).alias("keeper"), "n_docs", "n_rows")

    def merged(self, older: str, newer: str) -> DataFrame:
        """Both runs in one. At most one has an entry for a hash."""
        a = self.spark.table(older).withColumnsRenamed({c: f"older_{c}" for c in ("keeper", "n_docs", "n_rows")})
        rows = a.join(self.spark.table(newer).hint("merge"), self.KEYS, "full")
        plus = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"older_{c}", F.lit(0))).alias(c)
        return rows.select(*self.KEYS, F.coalesce("keeper", "older_keeper").alias("keeper"), plus("n_docs"), plus("n_rows"))

    def _compact(self, runs: list[str]) -> str:
        """One run of several, the newest two first."""
        runs = list(runs)
        while len(runs) > 1:
            newer, older = runs.pop(), runs.pop()
            runs.append(self._write(self.merged(older, newer)))
            self._forget(older, newer)
        return runs[0]

    def _forget(self, *runs: str) -> None:
        """Out of the catalog; the files are left to whoever owns the shared folder."""
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    @contextmanager
    def _sorted_scans(self) -> Iterator[None]:
        """Scans of buckets of one file keep the order the file has."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        was = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, was)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, top, n_docs, n_rows), unique by hash, of documents smaller than all added before."""
        with self._sorted_scans():
            self.levels[0].append(self._write(self.marked(batch)))
            for k, level in enumerate(self.levels):
                if len(level) >= self.fanout:
                    if k + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[k + 1].append(self._compact(level))
                    level.clear()

    @contextmanager
    def entries(self) -> Iterator[DataFrame]:
        """All entries, in one run."""
        with self._sorted_scans():
            self.levels = [[self._compact(self._all())]]
            yield self.spark.table(self.levels[0][0])
        self._forget(self.levels[0][0])


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    key = line_key(F.col("line"))
    text = text_of(docs)
    return (
        docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("id", "th", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(id, th, drop array<int>) for each document, by id and text hash, that loses lines."""
    spark = docs.sparkSession
    lines = stored(_lines(docs, min_chars), "lines")
    cuts = sorted({int(x) for x in lines.stat.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)}, reverse=True)
    runs = LineRuns(spark, fanout)
    upper = None
    for low in [*cuts, None]:
        part = lines
        if low is not None:
            part = part.where(F.col("id") >= low)
        if upper is not None:
            part = part.where(F.col("id") < upper)
        upper = low
        each = part.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n_rows"))
        runs.add(each.groupBy("h1", "h2").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_rows").alias("n_rows")))
    with runs.entries() as entries:
        met = hot_join(lines, entries, LineRuns.KEYS, "n_rows", lines.count(), F.col("n_docs") >= min_docs)
        return stored(met.where(F.col("id") != F.col("keeper")).groupBy("id", "th").agg(F.collect_set("pos").alias("drop")), "drops")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text rewritten, and __pl_n_lines, __pl_n_dropped."""
    text = text_of(docs)
    drops = dropped_positions(docs, **options).select(F.col("id").alias("__pl_id"), F.col("th").alias("__pl_th"), F.col("drop").alias("__pl_drop"))
    lines = F.split(text_of(docs), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__pl_drop"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    key = docs.withColumns({"__pl_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), "__pl_th": F.xxhash64(text)})
    joined = key.join(drops, ["__pl_id", "__pl_th"], "left")
    lines_out = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).cast("long")
    return joined.withColumns(
        {"__pl_n_lines": lines_out, "__pl_n_dropped": F.coalesce(F.size("__pl_drop"), F.lit(0)).cast("long"), "text": F.when(F.col("__pl_drop").isNull(), F.col("text")).otherwise(kept)}
    ).drop("__pl_id", "__pl_th", "__pl_drop")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    out = drop_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.col("__pl_n_lines").alias("n_lines"), F.col("__pl_n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line,
       translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
