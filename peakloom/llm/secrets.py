"""Secret scans with corpus-wide ownership frequency.

Spans of three base kinds (assignments, access keys, hex runs) are always reported. The method then decides on candidates
of a further kind, ``generic`` (runs of 32 or more of ``[A-Za-z0-9+/_-]`` with a digit, a capital and a small letter that overlap no base
span): each candidate's hash is counted over distinct repositories (documents) and owners (sources). A value that more than ``max_owners`` owners or more than
``max_repositories`` repositories have is a copied example and is not reported; any other belongs to its owner, looks live and is added. Base spans
are labelled by the same counts (``n_live``, ``n_example``).

Positions are code points: a text is split at a pattern, and the lengths of pieces and matches are added up by a window over the text's
matches, in time that grows with their number. Values that a large share of all spans have, boundedly many, meet their counts by broadcast.
Defined cases: a null or empty text has no spans; each row is scanned, repeated ones too; a null source is an owner of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, stored, table, text_of

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_-]{32,}"
KINDS = ("assign", "access", "hex", "generic")


#: Patterns by rank, the kind's place in KINDS.
PATTERNS = (ASSIGN, ACCESS, HEX, GENERIC)
BASE = len(KINDS) - 1


def _wanted(rank: Column, value: Column) -> Column:
    """Whether a match is a span of its kind."""
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Z]")) & F.rlike(value, F.lit("[a-z]"))
    return F.when(rank == 0, F.length(F.regexp_extract(value, ASSIGN, 2)) >= 6).when(rank == 1, F.length(value) >= 20).when(rank == 2, F.length(value) >= 24).otherwise(mixed)


def _matches(text: Column, rank: int) -> Column:
    """array<struct<rank, k, gap, value>>: the k-th match, and the code points between it and the one before."""
    pattern = PATTERNS[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("value")), 1, F.size(found))
    each = F.transform(pairs, lambda x, k: F.struct(F.lit(rank).alias("rank"), k.alias("k"), x["gap"].alias("gap"), x["value"].alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), each).otherwise(F.array().cast("array<struct<rank:int,k:int,gap:int,value:string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, owner, found (the matches of all kinds) of each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", docs["source"].cast("string").alias("owner"), text_of(docs).alias("text"))
    return rows.select("row", "doc_id", "owner", F.concat(*[_matches(F.col("text"), rank) for rank in range(len(KINDS))]).alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """row, doc_id, owner, start, rank, end, value of each span. Generic ones that a base span overlaps go: of the base spans that begin before such a span's end, the
    greatest end is compared with its start."""
    each = scanned.select("row", "doc_id", "owner", F.explode("found").alias("m")).select("row", "doc_id", "owner", "m.*")
    placed = Window.partitionBy("row", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(placed).cast("int")).withColumn("start", F.col("end") - F.length("value"))
    each = each.where(_wanted(F.col("rank"), F.col("value")))
    base = F.col("rank") < BASE
    sweep = Window.partitionBy("row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("reach", F.coalesce(F.max(F.when(base, F.col("end"))).over(sweep), F.lit(0)))
    return each.where(base | (F.col("reach") <= F.col("start"))).select("row", "doc_id", "owner", "start", "rank", "end", "value")


def _rendered(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates (h1, h2, owner, repository): owners and repositories of each value, counted apart, and its rows."""
    pairs = candidates.groupBy("h1", "h2", "owner", "repository").agg(F.count(F.lit(1)).alias("n_rows"))
    per_owner = pairs.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n_rows").alias("n_rows"))
    return per_owner.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n_rows").alias("n_rows"))


def find_secrets(docs: DataFrame, max_owners: int = 2, max_repositories: int = 10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of each document (doc_id, source, text)."""
    scanned = stored(scan(docs), "secrets")
    some = F.size("found") > 0
    each = spans(scanned.where(some)).withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(7), "value")}).drop("value")
    each = stored(each.withColumns({"owner": F.coalesce(F.concat(F.lit("s"), F.col("owner")), F.lit("n")), "repository": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}).drop("doc_id"), "spans")
    values = stored(ownership(each), "values")
    judged = hot_join(each, values.withColumnsRenamed({"owners": "n_owners", "repositories": "n_repositories"}), ["h1", "h2"], "n_rows", each.count())
    judged = judged.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    base, span = F.col("rank") < BASE, F.struct("start", "rank", "end")
    in_order = lambda kept: F.array_sort(F.collect_list(F.when(kept, span)))
    counted = lambda kind: F.count_if(F.col("rank") == KINDS.index(kind)).alias(f"n_{kind}")
    judged = judged.groupBy("row").agg(
        counted("assign"), counted("access"), counted("hex"), in_order(base).alias("base"), in_order(base | F.col("live")).alias("all"),
        F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    out = scanned.where(some).select("row", "doc_id").join(judged, "row", "left").drop("row").unionByName(scanned.where(~some).select("doc_id"), allowMissingColumns=True)
    shown = lambda c: F.coalesce(_rendered(F.col(c)), F.lit(""))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", none("n_assign"), none("n_access"), none("n_hex"), F.sha2(shown("base"), 256).alias("base_sha256"), shown("all").alias("spans"), none("n_live"), none("n_example"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _oracle_spans(kind: str, rank: int, pattern: str, wanted: str) -> str:
    """SQL for (doc_id, start, rank, end, kind, value): the k-th match ends where k gaps and k matches end."""
    return f"""
SELECT doc_id, stop - length(value) AS start, {rank} AS rank, stop AS "end", '{kind}' AS kind, value FROM (
  SELECT doc_id, value, sum(length(value) + gap) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM (
    SELECT doc_id, unnest(found) AS value, unnest(list_transform(gaps[1:len(found)], lambda g: length(g))) AS gap, generate_subscripts(found, 1) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)))
WHERE {wanted}"""


_A = ASSIGN.replace("'", "''")
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
b AS ({_oracle_spans("assign", 0, _A, f"length(regexp_extract(value, '{_A}', 2)) >= 6")}
UNION ALL {_oracle_spans("access", 1, ACCESS, "length(value) >= 20")}
UNION ALL {_oracle_spans("hex", 2, HEX, "length(value) >= 24")}),
g AS (SELECT * FROM ({_oracle_spans("generic", 3, GENERIC, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')")}) x
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.start < x."end" AND x.start < b."end")),
a AS (SELECT s.*, d.source FROM (SELECT * FROM b UNION ALL SELECT * FROM g) s JOIN d USING (doc_id)),
o AS (SELECT value, count(DISTINCT coalesce('s' || source, 'n')) <= 2 AND count(DISTINCT (coalesce('s' || source, 'n'), doc_id)) <= 10 AS live FROM a GROUP BY value),
j AS (SELECT a.*, o.live, kind || ':' || start || ':' || "end" AS said FROM a JOIN o USING (value)),
r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(said, ',' ORDER BY start, rank) FILTER (kind <> 'generic') AS base, string_agg(said, ',' ORDER BY start, rank) FILTER (kind <> 'generic' OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN r USING (doc_id)
"""
