"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a word target: the weights share ``share`` times all words, no target passes ``max_repeat`` times the
source, and what a capped source leaves goes to the others by weight. A target is met by whole passes over the source
and one partial pass: documents whose 60-bit hash lies below a threshold. The threshold is found by summing sizes in
4,096 hash buckets per source, taking the bucket where the running sum passes the budget, and summing again only inside
that bucket, ``LEVELS`` times. The thresholds nest: a larger budget keeps all that a smaller one takes. Nothing is sorted.

Defined cases: a null text has size 0; a null source is a source of its own, the last; rows that share doc_id and text
share a hash, and if the threshold falls on them each gives the same fraction of its words, rounded down, as does the single
document at the threshold; a source without words has target 0; texts may have any length, their words being counted and never kept; an empty table gives an empty result.
Other columns are ignored (``mix_sources``) or passed through (``apply_mix``); names beginning with ``__pl_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, WS, stored, table, text_of

BITS, LEVELS = 12, 5


def _hash60(doc_id: Column, text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), text)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """sizes: (source, size). One row per source: source, source_size, target.

    With the sources in order of cap per weight, the level at which all are served is the largest of
    (budget - caps before) / (weights from here on); the windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    per = per.withColumn("left_w", F.sum("w").over(everything) - before("w"))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before("cap")) / F.col("left_w"))
    return per.select("source", "source_size", F.round(F.least("cap", F.max("level").over(everything) * F.col("w")), 6).alias("target"))


def _crossing(hist: DataFrame) -> DataFrame:
    """hist: (source, prefix, budget, bucket, size). The bucket of each source in which the running sum passes the budget."""
    w = Window.partitionBy("source").orderBy("bucket")
    run = hist.withColumn("upto", F.sum("size").over(w))
    first = run.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min_by(F.struct("prefix", "bucket", "budget", "upto", "size"), "bucket").alias("c"))
    return first.select("source", (F.shiftleft("c.prefix", BITS) + F.col("c.bucket")).alias("prefix"), (F.col("c.budget") - F.col("c.upto") + F.col("c.size")).alias("budget"), F.col("c.size").alias("inside"))


def mixed(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """sized: (doc_id, source, size, h, ...), stored. Adds source_size, target, taken."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    targets = stored(source_targets(sized, weights, share, max_repeat), "targets").withColumn("source", key)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", passes)
    edge = targets.select("source", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
    rows = sized.select(key.alias("source"), "h", "size").where(F.col("size") > 0)
    for level in range(LEVELS):
        rest = BITS * (LEVELS - level - 1)
        bucket = F.shiftright("h", rest).bitwiseAND(F.lit(2**BITS - 1))
        inside = F.shiftright("h", rest + BITS).alias("prefix")
        sums = rows.groupBy("source", inside, bucket.alias("bucket")).agg(F.sum("size").alias("size")) if level == 0 else (
            rows.join(edge.select("source", F.col("prefix").alias("at")), "source").where(F.shiftright("h", rest + BITS) == F.col("at"))
            .groupBy("source", inside, bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        )
        edge = stored(_crossing(sums.join(edge, ["source", "prefix"])), "edge")
    extra = F.when(F.col("h") < F.col("prefix"), F.col("size")).when(F.col("h") == F.col("prefix"), F.floor(F.col("size") * F.col("budget") / F.col("inside"))).otherwise(0)
    plan = targets.join(edge, "source", "left").select(F.col("source").alias("__pl_key"), "source_size", "target", "passes", "prefix", "budget", "inside")
    return sized.withColumn("__pl_key", key).join(plan, "__pl_key").withColumn("taken", (F.col("passes") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long")).drop("__pl_key", "passes", "prefix", "budget", "inside")


def sized(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select("doc_id", docs["source"].cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _hash60(docs["doc_id"], docs["text"]).alias("h"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    return mixed(stored(sized(docs), "sized"), weights, share, max_repeat).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them: a row for each full pass over a document, and one with its first words where the mix ends inside it."""
    base = docs.withColumns({"__pl_h": _hash60(docs["doc_id"], docs["text"]), "__pl_size": F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")})
    plan = mixed(stored(sized(docs), "sized"), **options)
    # Rows that share doc_id, source and text share every figure of the plan.
    plan = plan.select(F.col("doc_id").alias("__pl_id"), F.coalesce("source", F.lit("")).alias("__pl_source"), F.col("source").isNull().alias("__pl_null"), F.col("h").alias("__pl_at"), F.col("taken").alias("__pl_taken")).distinct()
    on = base["doc_id"].eqNullSafe(F.col("__pl_id")) & (F.col("__pl_h") == F.col("__pl_at")) & (F.coalesce(base["source"].cast("string"), F.lit("")) == F.col("__pl_source")) & (base["source"].isNull() == F.col("__pl_null"))
    joined = base.join(plan.where("__pl_taken > 0"), on)
    full = F.floor(F.col("__pl_taken") / F.col("__pl_size")).cast("int")
    part = F.col("__pl_taken") - full * F.col("__pl_size")
    shares = F.concat(F.array_repeat(F.lit(0).cast("long"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    # What follows the last word taken is cut off; the text before it stays as it is.
    words = F.split(F.ltrim("text", F.lit(WS)), r"[\x20\x09-\x0D]+", F.col("__pl_part").cast("int") + 1)
    rest = F.coalesce(F.get(words, F.col("__pl_part").cast("int")), F.lit(""))
    cut = F.rtrim(F.substring("text", F.lit(1), F.length("text") - F.length(rest)), F.lit(WS))
    out = joined.withColumn("__pl_part", F.explode(shares)).withColumn("text", F.when(F.col("__pl_part") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__pl_part") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM w
      WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, round(least(cap, max(level) OVER () * w), 6) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.target - q.passes * q.source_size AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (passes * size + CASE WHEN upto <= budget THEN size WHEN upto - here < budget THEN floor(size * ((budget - upto) + here) / here) ELSE 0 END)::BIGINT AS taken FROM r
"""
