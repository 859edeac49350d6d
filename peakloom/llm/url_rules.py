"""URL rules by sorted sweeps over reversed-host keys.

A host's labels in reverse order, each with a dot behind it, are its key: ``www.example.com`` becomes
``com.example.www.``. A rule's host and its subdomains are then the keys from the rule's key up to that key with its last dot
replaced by the next character, so rules are intervals and intervals of hosts nest or are disjoint. Urls
and rule hosts are range-partitioned by key and swept in order. The sweep's stack has a slot for each depth (number of
labels) at which a rule host exists, holding the rule host opened last at that depth; a slot is active while the
swept key lies inside the slot's interval. What is open where a partition begins comes from the partitions before it, one
row each.

A second sweep, over (rule host, path), does the same for paths: each url is placed once under each rule host that is open for it, and the rule that begins last
before its path has all rules that fit among the prefixes of its own path. These are few, found by an equi-join of the rules' prefixes, and the longest
that begins the url's path is that host's rule. Equal keys are spread by a hash, so neither a host nor a path with many urls is one task, and nothing is
joined by host.

Of all rules that fit, the longest (host and path together; on equal lengths the longer host) decides. Defined cases: a null
url, or one without ``://``, has empty host and path; where no rule fits, rule is null and the verdict is
``default``; repeated rows are judged each; of rules with one host and path the greatest verdict counts; empty tables give empty results; a rule list may be empty; urls may have any
length, and rule paths of n characters take n rows while rules are prepared; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _swept(events: DataFrame, slots: dict[str, Column], order: list[str], partitions: int) -> DataFrame:
    """events with, for each slot, its last value that is not null among the events up to each, in order."""
    placed = stored(events.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "sweep")
    sweep = Window.partitionBy("part").orderBy(*order)
    inside = placed.withColumns({name: F.last(slot, True).over(sweep) for name, slot in slots.items()})
    ends = placed.groupBy("part").agg(*[F.max_by(slot, F.when(slot.isNotNull(), F.struct(*order))).alias(name) for name, slot in slots.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = ends.select("part", *[F.last(name, True).over(earlier).alias(f"before_{name}") for name in slots])
    rows = inside.join(carried, "part")
    return rows.withColumns({name: F.coalesce(name, f"before_{name}") for name in slots}).drop("part", *[f"before_{name}" for name in slots])


def _under_hosts(urls: DataFrame, rules: DataFrame, depths: list[int], partitions: int) -> DataFrame:
    """urls (row, page_id, host, path) with open array<string>: the keys of the rule hosts whose interval holds the url's host."""
    starts = rules.select("key", F.size(F.split("host", r"\.")).alias("depth")).distinct()
    events = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("turn"), F.xxhash64("row").alias("salt"), F.lit(None).cast("int").alias("depth"), "row", "page_id", "host", "path")
    none = [F.lit(None).cast(t).alias(c) for c, t in urls.dtypes]
    events = events.unionByName(starts.select("key", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("salt"), "depth", *none))
    rows = _swept(events, {f"s{d}": F.when(F.col("depth") == d, F.col("key")) for d in depths}, ["key", "turn", "salt"], partitions)
    open_ = F.filter(F.array(*[f"s{d}" for d in depths]), lambda x: x.isNotNull() & F.startswith(F.col("key"), x))
    return rows.where("turn = 1").select("row", "page_id", "host", "path", open_.alias("open"))


def _chains(rules: DataFrame) -> DataFrame:
    """key, path and chain: the rules of that host whose paths begin this one's, itself included."""
    each = rules.select("key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k")).select("key", "path", F.substring("path", F.lit(1), F.col("k")).alias("prefix"))
    there = rules.select("key", F.col("path").alias("prefix"), F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("hosted"), "host", F.col("path").alias("path"), "verdict").alias("rule"))
    return each.join(there, ["key", "prefix"]).groupBy("key", "path").agg(F.collect_list("rule").alias("chain"))


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url)."""
    spark = pages.sparkSession
    host, path = url_parts(pages["url"])
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = spark.createDataFrame(list(rules), "host string, path string, verdict string").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    depths = sorted({r[0].count(".") + 1 for r in rules})
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    opened = _under_hosts(urls.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path"), listed, depths, partitions)
    own = ["row", "page_id", "host"]
    asked = opened.select(F.explode("open").alias("key"), "path", F.lit(1).alias("turn"), F.xxhash64("row").alias("salt"), *own)
    chains = _chains(listed)
    kind = chains.schema["chain"].dataType
    starts = chains.select("key", "path", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("salt"), *[F.lit(None).cast(t).alias(c) for c, t in opened.select(own).dtypes], "chain")
    events = asked.withColumn("chain", F.lit(None).cast(kind)).unionByName(starts)
    met = _swept(events, {"last": F.when(F.col("turn") == 0, F.struct("key", "chain"))}, ["key", "path", "turn", "salt"], partitions).where("turn = 1")
    fits = F.filter(F.col("last.chain"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.when(F.col("last.key") == F.col("key"), F.array_max(fits))
    judged = met.withColumn("best", best).groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max("best").alias("best"))
    judged = judged.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    alone = opened.where(F.size("open") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(alone)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT h.page_id, max_by(rh || rp, (length(rh || rp), length(rh))) AS rule, max_by(rv, (length(rh || rp), length(rh))) AS rv
      FROM h JOIN r ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.rv, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
