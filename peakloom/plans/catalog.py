"""Registered queries over the shared tables, each whole, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.constants import BLOCKS_TSV, MASS_UNIT
from ..operators import candidates, compare, consensus, dependencies, diagnostics, fit, lattice, network, usage
from ..operators.storage import settled
from ..sources import dictionary
from ..sources.peaks import lenient_value
from .solve import SolveConfig, solve
from .tables import COMMON, FLAGS, LIMITS, LIMITS8, MASSES, MASSES8, NAMES, NAMES8, NATION_SQL, NODES_SQL, PEAKS_SQL, nation_peaks, nodes, peaks, read, residuals, usage_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOLERANCE, WIDE = 0.5, 2.0
BY = ("sample_id", "model")


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL where there is some."""

    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def text(column: str = "composition"):
    return F.array_join(F.col(column).cast("array<string>"), ",")


def sixth(column: str):
    """To six decimals as SQL rounds: the product is rounded, not the decimal digits of the value, which may fall on the other side of a half."""
    return (F.round(F.col(column) * 1e6) / 1e6).alias(column)


# ---- usage events -------------------------------------------------------------------------------------------------

query("usage_totals", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")(lambda s, d: usage.totals(usage_events(s, d)))
query("usage_span", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events")(lambda s, d: usage.span(usage_events(s, d)))
query("usage_recent20", "SELECT event_id AS id, event_type AS kind, ts FROM events ORDER BY event_id DESC LIMIT 20")(lambda s, d: usage.recent(usage_events(s, d)))
query("usage_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: usage.daily(usage_events(s, d)))
query("usage_busiest_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 5")(lambda s, d: usage.busiest_days(usage_events(s, d)))

# ---- candidate discovery ------------------------------------------------------------------------------------------

KNOWN, MIN_DIFF, LOWER, UPPER = (MASSES[0],), 40.0, 35.0, 370.0
_native = [line.split("\t") for line in BLOCKS_TSV.splitlines()]
_native = [(k, r[0], float(r[1]), r[2]) for k, r in enumerate(_native) if r[4] == "native" and r[2] != "meta"]
DICT_SQL = "dict(ord, name, mass, category) AS (VALUES " + ", ".join(f"({k}, '{n}', {m!r}::DOUBLE, '{c}')" for k, n, m, c in _native) + ")"
DIFF_SQL = f"""{PEAKS_SQL},
diffs AS (SELECT a.sample_id, a.peak_id AS i, b.peak_id AS j, abs((a.observed - {COMMON!r}::DOUBLE) - (b.observed - {COMMON!r}::DOUBLE)) AS diff FROM peaks a JOIN peaks b ON a.sample_id = b.sample_id AND a.peak_id < b.peak_id
  WHERE abs((a.observed - {COMMON!r}::DOUBLE) - (b.observed - {COMMON!r}::DOUBLE)) > {MIN_DIFF})"""
CASCADE_SQL = f"""{DIFF_SQL}, {DICT_SQL},
known(pos, mass) AS (VALUES (0, {KNOWN[0]!r}::DOUBLE)),
refs AS (SELECT min(pos) AS pos, arg_min(mass, pos) AS mass, arg_max(label, pos) AS label FROM (
  SELECT pos, mass, printf('%.3f', mass) AS label FROM known UNION ALL SELECT ord + 1, mass, name || '(' || printf('%.3f', mass) || ')' FROM dict) GROUP BY round(mass, 6)),
counts AS (SELECT c, d FROM range(4) t(c), range(4) u(d) WHERE c + d >= 2),
ex AS (
  SELECT [1, pos, n, 0, 0] AS ord, mass * n AS mass, CASE WHEN n = 1 THEN 'Too close to known block ' || printf('%.3f', mass) ELSE 'Multiple of ' || printf('%.3f', mass) || ' (' || n || 'x)' END AS reason FROM known, range(1, 10) t(n)
  UNION ALL SELECT [2, a.pos, b.pos, c, d], c * a.mass + d * b.mass, 'Combination of ' || c || 'x' || a.label || ' + ' || d || 'x' || b.label FROM refs a JOIN refs b ON a.pos <= b.pos, counts
  UNION ALL SELECT [3, a.pos, b.pos, 0, 0], a.mass - b.mass, 'Difference between ' || a.label || ' and ' || b.label FROM refs a JOIN refs b ON a.mass > b.mass),
hit AS (SELECT sample_id, i, j, diff, arg_min(reason, ord) AS reason, min(ord)[1] AS rule FROM diffs JOIN ex ON diff BETWEEN mass - 0.26 AND mass + 0.26 AND abs(diff - mass) < 0.25 GROUP BY ALL),
judged AS (SELECT d.sample_id, d.i, d.j, d.diff, coalesce(
    CASE WHEN rule > 1 AND EXISTS (SELECT 1 FROM dict WHERE abs(d.diff - dict.mass) < 0.25) THEN NULL ELSE reason END,
    CASE WHEN d.diff < {LOWER} THEN 'Below lower bound {LOWER:.3f}' END, CASE WHEN d.diff > {UPPER} THEN 'Above upper bound {UPPER:.3f}' END) AS reason
  FROM diffs d LEFT JOIN hit USING (sample_id, i, j))"""
CLUSTER_SQL = f"""{CASCADE_SQL},
opened AS (SELECT *, CASE WHEN diff - lag(diff) OVER (PARTITION BY sample_id ORDER BY diff) <= 0.25 THEN 0 ELSE 1 END AS opens FROM judged WHERE reason IS NULL),
clustered AS (SELECT sample_id, diff, sum(opens) OVER (PARTITION BY sample_id ORDER BY diff ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM opened),
stats AS (SELECT sample_id, cluster, count(*) AS size, var_pop(diff) AS variance, median(diff) AS median, min(diff) AS low, max(diff) AS high FROM clustered GROUP BY 1, 2),
scored AS (SELECT *, (SELECT arg_min(name, ord) FROM dict WHERE abs(median - mass) < 0.25) AS name,
  size * CASE WHEN size = 1 THEN 1.0 WHEN variance < 1e-10 THEN 1000.0 ELSE 1 / (variance + 0.001) END
  * CASE WHEN EXISTS (SELECT 1 FROM dict WHERE category = 'mod' AND abs(median - mass) < 0.25) THEN 1.0 ELSE exp(-4 * abs(median - round_even(median / {MASS_UNIT}, 0) * {MASS_UNIT})) END
  * CASE WHEN EXISTS (SELECT 1 FROM dict WHERE abs(median - mass) < 0.25) THEN 10.0 ELSE 1.0 END AS score FROM stats),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, median) AS rank FROM scored)"""


def _filtered(s, d):
    return candidates.filter_differences(candidates.pair_differences(peaks(s, d), COMMON, MIN_DIFF), dictionary.blocks(s), KNOWN, LOWER, UPPER)


def _ranked(s, d):
    return candidates.discover(peaks(s, d), dictionary.blocks(s), COMMON, KNOWN, MIN_DIFF, LOWER, UPPER)[0]


@query("peak_pair_differences", f"WITH {DIFF_SQL} SELECT sample_id, i, j, round(diff, 6) AS diff FROM diffs")
def peak_pair_differences(s, d):
    return candidates.pair_differences(peaks(s, d), COMMON, MIN_DIFF).withColumn("diff", F.round("diff", 6))


@query("filter_cascade", f"WITH {CASCADE_SQL} SELECT sample_id, i, j, round(diff, 6) AS diff, reason FROM judged")
def filter_cascade(s, d):
    return _filtered(s, d).select("sample_id", "i", "j", F.round("diff", 6).alias("diff"), "reason")


@query("gap_clusters", f"WITH {CLUSTER_SQL} SELECT sample_id, round(diff, 6) AS diff, cluster FROM clustered")
def gap_clusters(s, d):
    return candidates.gap_clusters(_filtered(s, d).where("reason IS NULL")).select("sample_id", F.round("diff", 6).alias("diff"), "cluster")


@query("rank_candidates", f"WITH {CLUSTER_SQL} SELECT sample_id, cluster, size, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, round(score, 3) AS score, name, rank FROM ranked")
def rank_candidates(s, d):
    r = lambda c, k=6: F.round(c, k).alias(c)
    return _ranked(s, d).select("sample_id", "cluster", "size", r("median"), r("low"), r("high"), r("score", 3), "name", F.col("rank").cast("long").alias("rank"))


EXCLUDED, PROTECTED = (203.079374,), (187.084459,)
_gone = [e * k for e in EXCLUDED for k in range(1, 6)] + [a * m + b * e for e in EXCLUDED for m in KNOWN for a in range(4) for b in range(4) if a + b]


@query("user_exclusion", f"WITH {CLUSTER_SQL} SELECT sample_id, rank, round(median, 6) AS median FROM ranked WHERE list_bool_or([" + ", ".join(f"abs(median - {p!r}) < 0.5" for p in PROTECTED) + "]) OR NOT list_bool_or([" + ", ".join(f"abs(median - {g!r}) < 0.5" for g in _gone) + "])")
def user_exclusion(s, d):
    return candidates.without_excluded(_ranked(s, d), EXCLUDED, KNOWN, PROTECTED).select("sample_id", F.col("rank").cast("long").alias("rank"), F.round("median", 6).alias("median"))


@query("available_candidates", f"WITH {CLUSTER_SQL}, free AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS turn FROM ranked WHERE abs(median - {MASSES[0]!r}) >= 0.5 AND abs(median - {MASSES[2]!r}) >= 0.5) SELECT sample_id, turn, round(median, 6) AS median FROM free WHERE turn <= 5")
def available_candidates(s, d):
    return candidates.available(_ranked(s, d), (MASSES[0], MASSES[2])).select("sample_id", F.col("turn").cast("long").alias("turn"), F.round("median", 6).alias("median"))


@query("name_for_mass", f"WITH {DICT_SQL} SELECT p_partkey, round(p_retailprice - 800, 6) AS mass, (SELECT arg_min(name, ord) FROM dict WHERE abs(p_retailprice - 800 - mass) < 0.5) AS name, coalesce((SELECT arg_min(category, ord) FROM dict WHERE abs(p_retailprice - 800 - mass) < 0.5), 'unknown') AS category FROM part")
def name_for_mass(s, d):
    rows = read(s, d, "part").select("p_partkey", (F.col("p_retailprice") - 800).alias("mass"))
    return candidates.named_by_mass(rows, dictionary.blocks(s)).select("p_partkey", F.round("mass", 6).alias("mass"), "name", "category")


# ---- lattice and models -------------------------------------------------------------------------------------------

_abcd = "a, b, c, d"
LATTICE_SQL = f"""{PEAKS_SQL}, lat AS (SELECT a, b, c, d, [a, b, c, d] AS comp, a + b + c + d AS copies, (a > 0)::INT + 2 * (b > 0)::INT + 4 * (c > 0)::INT + 8 * (d > 0)::INT AS used,
  (((0.0::DOUBLE + a * {MASSES[0]!r}::DOUBLE) + b * {MASSES[1]!r}::DOUBLE) + c * {MASSES[2]!r}::DOUBLE) + d * {MASSES[3]!r}::DOUBLE AS mass
  FROM range({LIMITS[0] + 1}) t(a), range({LIMITS[1] + 1}) u(b), range({LIMITS[2] + 1}) v(c), range({LIMITS[3] + 1}) w(d))"""
MODELS_SQL = f"""{LATTICE_SQL}, masks AS (SELECT m::INT AS mask, bit_count(m::INT)::INT AS n_blocks, array_to_string(list_filter(['Hex', 'HexNAc', 'dHex', 'NeuAc'], lambda x, i: (m >> (i - 1)) & 1 = 1), '+') AS model FROM range(1, 16) t(m)),
ml AS (SELECT mask, comp, copies, mass FROM lat JOIN masks ON used & (15 - mask) = 0),
fits AS (SELECT sample_id, peak_id, observed, mask, f.comp AS comp, f.error AS error FROM (
  SELECT p.sample_id, p.peak_id, p.observed, mask, min({{'error': abs((p.observed - {COMMON!r}::DOUBLE) - mass), 'copies': copies, 'comp': comp}}) AS f FROM peaks p, ml GROUP BY 1, 2, 3, 4)),
models AS (SELECT sample_id, mask, model, n_blocks, count(*) AS n, count(*) FILTER (error < {WIDE}) AS n_good, count(*) FILTER (error >= {WIDE}) AS n_bad, sum(error * error) AS rss, median(error) AS median_error,
  count(*) * ln(greatest(sum(error * error), 1e-10) / count(*)) + n_blocks * ln(count(*)) AS bic FROM fits JOIN masks USING (mask) GROUP BY sample_id, mask, model, n_blocks)"""


def _fits(s, d, masks):
    return lattice.closest(peaks(s, d), MASSES, LIMITS, COMMON, masks)


def _models(s, d):
    """Subset models under the tolerance WIDE, and their fits. A fit is a lookup, cheaper to repeat than to store."""
    masks = lattice.subset_masks(s, NAMES)
    fits = _fits(s, d, masks)
    return fits, compare.model_summary(fits, masks, WIDE)


def _shown(models):
    r = lambda c, k=6: F.round(F.col(c) + 1e-8, k).alias(c)  # noqa: E731  half-way values round up on either side
    return models.select("sample_id", "mask", "model", "n_blocks", "n", "n_good", "n_bad", r("rss", 1), r("median_error"), r("bic"))


_SHOWN = "SELECT sample_id, mask, model, n_blocks, n, n_good, n_bad, round(rss + 1e-8, 1) AS rss, round(median_error + 1e-8, 6) AS median_error, round(bic + 1e-8, 6) AS bic"


@query("lattice_nearest", f"WITH {LATTICE_SQL}, f AS (SELECT sample_id, peak_id, min({{'error': abs((observed - {COMMON!r}::DOUBLE) - mass), 'copies': copies, 'comp': comp}}) AS f FROM peaks, lat GROUP BY 1, 2) SELECT sample_id, peak_id, array_to_string(f.comp, ',') AS composition, round(f.error, 6) AS error FROM f")
def lattice_nearest(s, d):
    return lattice.closest(peaks(s, d), MASSES, LIMITS, COMMON).select("sample_id", "peak_id", text().alias("composition"), sixth("error"))


_back8 = "((((((0.0::DOUBLE + " + ") + ".join(f"n[{k}] * {m!r}::DOUBLE" for k, m in enumerate(MASSES8[2:], 1)) + ")"
LATTICE8_SQL = f"""fronts AS (SELECT [a, b]::INT[] AS n, (0.0::DOUBLE + a * {MASSES8[0]!r}::DOUBLE) + b * {MASSES8[1]!r}::DOUBLE AS mass FROM range(11) t(a), range(5) u(b)),
backs AS (SELECT n, {_back8} AS mass FROM (SELECT [c, d, e, f, g, h]::INT[] AS n FROM range(5) t(c), range(5) u(d), range(5) v(e), range(5) w(f), range(5) x(g), range(5) y(h))),
points AS MATERIALIZED (SELECT f.mass + b.mass AS mass, list_sum(f.n)::INT + list_sum(b.n)::INT AS copies, list_concat(f.n, b.n) AS comp FROM fronts f, backs b)"""
_one8 = "min({'copies': copies, 'comp': comp, 'mass': mass}) AS p"
_near8 = "min({'near': round_even(error * 1e6, 0), 'copies': p.copies, 'comp': p.comp, 'error': error}) AS f"


@query("lattice_nearest8", f"""WITH {PEAKS_SQL}, {LATTICE8_SQL}, lat AS MATERIALIZED (SELECT p.mass AS mass, p FROM (SELECT {_one8} FROM points GROUP BY round_even(mass * 1e6, 0))), t AS (SELECT *, observed - {COMMON!r}::DOUBLE AS target FROM peaks),
sides AS (SELECT sample_id, peak_id, abs(target - mass) AS error, p FROM t ASOF JOIN lat ON t.target >= lat.mass UNION ALL SELECT sample_id, peak_id, abs(target - mass), p FROM t ASOF JOIN lat ON t.target <= lat.mass),
f AS (SELECT sample_id, peak_id, {_near8} FROM sides GROUP BY 1, 2)
SELECT sample_id, peak_id, array_to_string(f.comp, ',') AS composition, round(f.error, 6) AS error FROM f""")
def lattice_nearest8(s, d):
    """Of 859,375 compositions of eight blocks."""
    return lattice.closest_of_many(peaks(s, d), MASSES8, LIMITS8, COMMON).select("sample_id", "peak_id", text().alias("composition"), sixth("error"))


@query("lattice_alternatives8", f"""WITH {NATION_SQL}, {LATTICE8_SQL}, t AS (SELECT *, observed - {COMMON!r}::DOUBLE AS target FROM peaks),
met AS (SELECT sample_id, peak_id, comp, abs(target - mass) AS error, row_number() OVER (PARTITION BY sample_id, peak_id ORDER BY comp) AS dfs FROM t JOIN points ON mass BETWEEN t.target - 0.51 AND t.target + 0.51 WHERE abs(target - mass) < {TOLERANCE}),
alts AS (SELECT sample_id, peak_id, row_number() OVER (PARTITION BY sample_id, peak_id ORDER BY error, dfs) AS alternative, comp, error FROM met WHERE dfs <= 500)
SELECT sample_id, peak_id, alternative, array_to_string(comp, ',') AS composition, round(error, 6) AS error FROM alts
UNION ALL SELECT sample_id, peak_id, 1, '0,0,0,0,0,0,0,0', 'inf'::DOUBLE FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM alts a WHERE a.sample_id = p.sample_id AND a.peak_id = p.peak_id)""")
def lattice_alternatives8(s, d):
    rows = lattice.within(nation_peaks(s, d), MASSES8, LIMITS8, COMMON, TOLERANCE)
    return rows.select("sample_id", "peak_id", F.col("alternative").cast("long").alias("alternative"), text().alias("composition"), sixth("error"))


@query("subset_models8", f"""WITH {NATION_SQL}, {LATTICE8_SQL}, masks AS (SELECT m::INT AS mask FROM range(1, 256) t(m)), used AS (SELECT *, list_sum([CASE WHEN comp[i] > 0 THEN 1 << (i - 1) ELSE 0 END FOR i IN range(1, 9)])::INT AS used FROM points),
ml AS MATERIALIZED (SELECT mask, p.mass AS mass, p FROM (SELECT mask, {_one8} FROM used JOIN masks ON used & (255 - mask) = 0 GROUP BY mask, round_even(mass * 1e6, 0))), t AS MATERIALIZED (SELECT *, observed - {COMMON!r}::DOUBLE AS target FROM peaks, masks),
sides AS (SELECT sample_id, peak_id, t.mask, abs(target - mass) AS error, p FROM t ASOF JOIN ml ON t.mask = ml.mask AND t.target >= ml.mass UNION ALL SELECT sample_id, peak_id, t.mask, abs(target - mass), p FROM t ASOF JOIN ml ON t.mask = ml.mask AND t.target <= ml.mass),
f AS (SELECT sample_id, peak_id, mask, {_near8} FROM sides GROUP BY 1, 2, 3)
SELECT sample_id, mask, count(*) AS n, count(*) FILTER (f.error < {WIDE}) AS n_good, round(sum(f.error * f.error) + 1e-8, 4) AS rss FROM f GROUP BY 1, 2""")
def subset_models8(s, d):
    """All 255 models of eight blocks. A sample's peaks of one mass are fitted once and counted."""
    alike = nation_peaks(s, d).groupBy("sample_id", "observed").agg(F.min("peak_id").alias("peak_id"), F.count(F.lit(1)).alias("alike"))
    fits = lattice.closest_of_many(alike, MASSES8, LIMITS8, COMMON, lattice.subset_masks(s, NAMES8))
    e, n = F.col("error"), F.col("alike")
    return fits.groupBy("sample_id", "mask").agg(F.sum(n).alias("n"), F.sum(F.when(e < WIDE, n).otherwise(0)).alias("n_good"), F.round(F.sum(n * e * e) + 1e-8, 4).alias("rss"))


ALTERNATIVES_SQL = f"""{LATTICE_SQL}, met AS (SELECT sample_id, peak_id, comp, abs((observed - {COMMON!r}::DOUBLE) - mass) AS error, row_number() OVER (PARTITION BY sample_id, peak_id ORDER BY comp) AS dfs FROM peaks, lat WHERE abs((observed - {COMMON!r}::DOUBLE) - mass) < {WIDE}),
alts AS (SELECT sample_id, peak_id, row_number() OVER (PARTITION BY sample_id, peak_id ORDER BY error, dfs) AS alternative, comp, error FROM met WHERE dfs <= 500)"""


@query("lattice_alternatives", f"WITH {ALTERNATIVES_SQL} SELECT sample_id, peak_id, alternative, array_to_string(comp, ',') AS composition, round(error, 6) AS error FROM alts UNION ALL SELECT sample_id, peak_id, 1, '0,0,0,0', 'inf'::DOUBLE FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM alts a WHERE a.sample_id = p.sample_id AND a.peak_id = p.peak_id)")
def lattice_alternatives(s, d):
    rows = lattice.within(peaks(s, d), MASSES, LIMITS, COMMON, WIDE)
    return rows.select("sample_id", "peak_id", F.col("alternative").cast("long").alias("alternative"), text().alias("composition"), sixth("error"))


@query("ambiguity_margins", f"""WITH {ALTERNATIVES_SQL}, m AS (SELECT sample_id, peak_id, max(error) FILTER (alternative = 2) - max(error) FILTER (alternative = 1) AS margin FROM alts GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY margin) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM m WHERE margin IS NOT NULL)
SELECT sample_id, count(*) FILTER (margin >= 0.5) AS n_clear, count(*) FILTER (margin < 0.5) AS n_ambiguous, round(min(margin), 6) AS min_margin, round(max(margin) FILTER (k = n // 2 + 1), 6) AS median_margin, round(max(margin), 6) AS max_margin FROM k GROUP BY 1""")
def ambiguity_margins(s, d):
    rows = lattice.ambiguity_summary(lattice.ambiguity(lattice.within(peaks(s, d), MASSES, LIMITS, COMMON, WIDE)))
    return rows.select("sample_id", "n_clear", "n_ambiguous", *[sixth(c) for c in ("min_margin", "median_margin", "max_margin")])


@query("subset_models_bic", f"WITH {MODELS_SQL} {_SHOWN} FROM models")
def subset_models_bic(s, d):
    return _shown(_models(s, d)[1])


@query("nested_models_bic", f"WITH {MODELS_SQL} {_SHOWN} FROM models WHERE mask IN (1, 3, 7, 15)")
def nested_models_bic(s, d):
    masks = lattice.prefix_masks(s, NAMES, 1)
    return _shown(compare.model_summary(_fits(s, d, masks), masks, WIDE))


PRUNED_SQL = f"{MODELS_SQL}, pruned AS (SELECT * FROM models m WHERE NOT EXISTS (SELECT 1 FROM models p WHERE p.sample_id = m.sample_id AND p.n_bad = 0 AND p.mask <> m.mask AND m.mask & p.mask = p.mask))"
PEAK_SQL = f"""{PRUNED_SQL}, pf AS (SELECT f.*, m.model, m.n_blocks, list_sum(comp) AS copies, coalesce(list_min(list_filter([CASE WHEN comp[1] > 0 THEN {MASSES[0]!r} END, CASE WHEN comp[2] > 0 THEN {MASSES[1]!r} END, CASE WHEN comp[3] > 0 THEN {MASSES[2]!r} END, CASE WHEN comp[4] > 0 THEN {MASSES[3]!r} END], lambda x: x IS NOT NULL)), 0) AS lightest FROM fits f JOIN pruned m USING (sample_id, mask)),
ps AS (SELECT sample_id, peak_id, any_value(observed) AS observed, count(*) AS n_tested, count(*) FILTER (error < {WIDE}) AS n_explaining, count(DISTINCT comp) FILTER (error < {WIDE}) <= 1 AS consistent,
  (list({{'k1': n_blocks, 'k2': copies, 'k3': -lightest, 'k4': mask, 'model': model, 'comp': comp}} ORDER BY n_blocks, copies, -lightest, mask) FILTER (error < {WIDE}))[1] AS best FROM pf GROUP BY 1, 2)"""


@query("superset_prune", f"WITH {PRUNED_SQL} {_SHOWN} FROM pruned")
def superset_prune(s, d):
    return _shown(compare.level_search(peaks(s, d), NAMES, MASSES, LIMITS, COMMON, WIDE)[1])


@query("best_models", f"WITH {MODELS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY bic, n_blocks, mask) AS k FROM models) {_SHOWN.replace(' n, n_good', ' n_good')} FROM o WHERE k = 1")
def best_models(s, d):
    return _shown(compare.best_models(_models(s, d)[1]).withColumn("n", F.lit(0))).drop("n")


def _explained(s, d):
    return compare.explained_peaks(peaks(s, d), NAMES, MASSES, LIMITS, COMMON, WIDE)


def _peak_stats(s, d):
    """Nothing is stored: a sample's peaks are dealt out once, and a peak's fits of all models are in its row."""
    return compare.kept_statistics(compare.kept_fits(_explained(s, d), len(NAMES)))


@query("best_model_per_peak", f"WITH {PEAK_SQL} SELECT sample_id, peak_id, n_tested, n_explaining, consistent, best.model AS best_model, array_to_string(best.comp, ',') AS best_composition FROM ps")
def best_model_per_peak(s, d):
    return _peak_stats(s, d).select("sample_id", "peak_id", "n_tested", "n_explaining", "consistent", "best_model", text("best_composition").alias("best_composition"))


@query("model_share", f"WITH {PEAK_SQL}, c AS (SELECT sample_id, best.model AS best_model, count(*) AS n_peaks FROM ps WHERE best IS NOT NULL GROUP BY 1, 2) SELECT *, round(100 * n_peaks / sum(n_peaks) OVER (PARTITION BY sample_id), 6) AS percent FROM c")
def model_share(s, d):
    return compare.model_shares(_peak_stats(s, d)).withColumn("percent", F.round("percent", 6))


@query("simplest_prefix", f"WITH {MODELS_SQL} SELECT sample_id, peak_id, coalesce(min(n_blocks) FILTER (error < {WIDE}), 0)::INT AS simplest FROM fits JOIN masks USING (mask) WHERE mask IN (1, 3, 7, 15) GROUP BY 1, 2")
def simplest_prefix(s, d):
    masks = lattice.prefix_masks(s, NAMES, 1)
    return compare.simplest_prefix(_fits(s, d, masks), masks, WIDE).fillna(0, ["simplest"])


CANDIDATE_SQL = f"""{PEAK_SQL}, cand AS (SELECT sample_id, peak_id, comp, any_value(error) AS error, min(mask) AS mask FROM pf WHERE error < {WIDE} GROUP BY 1, 2, 3),
near AS (SELECT a.sample_id, a.peak_id, a.comp, count(DISTINCT b.peak_id) AS conn FROM cand a JOIN cand b ON a.sample_id = b.sample_id AND a.peak_id <> b.peak_id AND abs(a.comp[1] - b.comp[1]) + abs(a.comp[2] - b.comp[2]) + abs(a.comp[3] - b.comp[3]) + abs(a.comp[4] - b.comp[4]) = 1 GROUP BY 1, 2, 3),
pick AS (SELECT c.sample_id, c.peak_id, c.comp, row_number() OVER (PARTITION BY c.sample_id, c.peak_id ORDER BY coalesce(conn, 0) DESC, list_sum(c.comp), c.error, c.mask) AS k FROM cand c LEFT JOIN near USING (sample_id, peak_id, comp)),
bio AS (SELECT p.sample_id, p.peak_id, coalesce(k.comp, [0, 0, 0, 0]) AS comp FROM peaks p LEFT JOIN (SELECT * FROM pick WHERE k = 1) k USING (sample_id, peak_id))"""


def _bio(s, d):
    kept = compare.kept_fits(_explained(s, d), len(NAMES))
    explained = consensus.explaining_compositions(kept.select("sample_id", "peak_id", "observed", F.inline("good")), WIDE)
    return compare.kept_statistics(kept), consensus.network_consensus(peaks(s, d), explained, len(NAMES))


@query("bio_consensus", f"WITH {CANDIDATE_SQL} SELECT sample_id, peak_id, array_to_string(comp, ',') AS composition FROM bio")
def bio_consensus(s, d):
    return _bio(s, d)[1].select("sample_id", "peak_id", text().alias("composition"))


@query("consensus_differences", f"WITH {CANDIDATE_SQL} SELECT b.sample_id, b.peak_id, array_to_string(coalesce(best.comp, [0, 0, 0, 0]), ',') AS first, array_to_string(b.comp, ',') AS second FROM bio b JOIN ps USING (sample_id, peak_id) WHERE coalesce(best.comp, [0, 0, 0, 0]) <> b.comp")
def consensus_differences(s, d):
    stats, bio = _bio(s, d)
    rows = consensus.differences(consensus.simplest_consensus(stats, len(NAMES)), bio)
    return rows.select("sample_id", "peak_id", text("first").alias("first"), text("second").alias("second"))


DEP_SQL = f"""{PRUNED_SQL}, um AS (SELECT f.sample_id, f.mask, coalesce(bit_or((comp[1] > 0)::INT + 2 * (comp[2] > 0)::INT + 4 * (comp[3] > 0)::INT + 8 * (comp[4] > 0)::INT) FILTER (error < {WIDE}), 0) AS used FROM fits f JOIN pruned USING (sample_id, mask) GROUP BY 1, 2),
ub AS (SELECT sample_id, block::INT AS block, count(*) AS n_with, count(*) FILTER (used >> block & 1 = 1) AS n_used, count(*) FILTER (used >> block & 1 = 0) AS n_not_used, coalesce(bit_and(mask & (15 - (1 << block)::INT)) FILTER (used >> block & 1 = 1), 0) AS prerequisites FROM um, range(4) t(block) WHERE mask >> block & 1 = 1 GROUP BY 1, 2),
ind AS (SELECT a.sample_id, a.block, bit_or(b.prerequisites) AS further FROM ub a JOIN ub b ON a.sample_id = b.sample_id AND a.prerequisites >> b.block & 1 = 1 GROUP BY 1, 2)"""


def _dependencies(s, d):
    return dependencies.direct_dependencies(dependencies.block_usage_of_peaks(_explained(s, d), len(NAMES)))


@query("block_dependencies", f"WITH {DEP_SQL} SELECT ub.*, (prerequisites & ~coalesce(further, 0))::INT AS direct FROM ub LEFT JOIN ind USING (sample_id, block)")
def block_dependencies(s, d):
    return _dependencies(s, d).select("sample_id", "block", "n_with", "n_used", "n_not_used", "prerequisites", "direct")


_named = lambda mask, none: f"CASE WHEN {mask} = 0 THEN '{none}' ELSE array_to_string(list_sort(list_filter(['Hex', 'HexNAc', 'dHex', 'NeuAc'], lambda x, i: ({mask} >> (i - 1)) & 1 = 1)), '+') END"


@query("dependency_report", f"""WITH RECURSIVE {DEP_SQL}, dd AS (SELECT ub.*, (prerequisites & ~coalesce(further, 0))::INT AS direct FROM ub LEFT JOIN ind USING (sample_id, block)),
masks_of AS (SELECT sample_id, list(direct ORDER BY block) AS directs FROM dd GROUP BY 1),
steps AS (SELECT sample_id, directs, []::INT[] AS done, 15 AS waiting FROM masks_of UNION ALL
  SELECT sample_id, directs, list_append(done, least_free), waiting & ~(1 << least_free) FROM (
    SELECT *, list_min(list_filter([0, 1, 2, 3], lambda b: (waiting >> b) & 1 = 1 AND directs[b + 1] & waiting = 0))::INT AS least_free FROM steps) WHERE least_free IS NOT NULL),
ends AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY len(done) DESC) AS k FROM steps),
orders_of AS (SELECT sample_id, list_concat(done, list_filter([0, 1, 2, 3], lambda b: (waiting >> b) & 1 = 1)) AS ordering FROM ends WHERE k = 1)
SELECT sample_id, ['Hex', 'HexNAc', 'dHex', 'NeuAc'][block + 1] AS block, {_named("prerequisites", "(none)")} AS prerequisites, {_named("direct", "(root)")} AS direct_dependencies,
  list_position(ordering, block)::INT AS biosynthetic_order, n_with, n_used, n_not_used FROM dd JOIN orders_of USING (sample_id)""")
def dependency_report(s, d):
    return dependencies.dependency_report(_dependencies(s, d), NAMES)


# ---- compositions and networks ------------------------------------------------------------------------------------

_part = lambda n, c: f"CASE WHEN {c} > 0 THEN {c} || '{n}' END"
_parts = ", ".join(_part(n, c) for n, c in zip(FLAGS, "anr"))


@query("formula_strings", f"WITH {NODES_SQL} SELECT peak_id, coalesce(nullif(concat_ws('+', {_parts}), ''), 'Common') AS name, concat_ws(' + ', 'Core', {_parts}) AS formula, concat_ws(' + ', a || 'A', n + 2 || 'N', CASE WHEN r > 0 THEN r || 'R' END, '1X') AS structure, coalesce(nullif(concat_ws(' ', {', '.join(f"CASE WHEN {c} > 0 THEN '{n}×' || {c} END" for n, c in zip(FLAGS, 'anr'))}), ''), '(empty)') AS label FROM nodes".replace("concat_ws(' + ', a || 'A'", "concat_ws(' + ', CASE WHEN a > 0 THEN a || 'A' END"))
def formula_strings(s, d):
    names, c = exprs.strings(FLAGS), F.col("composition")
    return nodes(s, d).select("peak_id", exprs.composition_name(names, c).alias("name"), exprs.formula("Core", names, c).alias("formula"), exprs.merged_structure({"N": 2, "X": 1}, list(FLAGS), c).alias("structure"), exprs.composition_label(names, c).alias("label"))


EDGE_SQL = f"""{NODES_SQL}, deltas AS (SELECT x.sample_id, x.model, x.peak_id AS i, y.peak_id AS j, y.observed - x.observed AS gap, y.a - x.a AS da, y.n - x.n AS dn, y.r - x.r AS dr FROM nodes x JOIN nodes y ON x.sample_id = y.sample_id AND x.model = y.model AND (x.observed, x.peak_id) < (y.observed, y.peak_id)),
sized AS (SELECT *, abs(da) + abs(dn) + abs(dr) AS l1, greatest(da, dn, dr) > 0 AS up, least(da, dn, dr) < 0 AS down, (da <> 0)::INT + (dn <> 0)::INT + (dr <> 0)::INT AS blocks FROM deltas),
edges AS (SELECT *, CASE WHEN l1 = 0 THEN 'identity' WHEN up AND down THEN 'mixed' WHEN l1 = 1 THEN 'clean' WHEN blocks = 1 THEN 'skip' ELSE 'multi' END AS kind, CASE WHEN l1 = 0 THEN 2.0 WHEN up AND down THEN 2.0 * l1 ELSE l1 - 1.0 END AS penalty FROM sized)"""
_delta = lambda n, c: f"CASE WHEN {c} > 1 THEN '+' || {c} || '{n}' WHEN {c} = 1 THEN '+{n}' WHEN {c} < -1 THEN {c} || '{n}' WHEN {c} = -1 THEN '-{n}' END"
_flip = lambda n, c: f"CASE WHEN {c} < -1 THEN '+' || -{c} || '{n}' WHEN {c} = -1 THEN '+{n}' END"
_label = "coalesce(nullif(concat_ws(' ', " + ", ".join(_delta(n, f"d{c}") for n, c in zip(FLAGS, "anr")) + "), ''), '±0')"
_added = "CASE WHEN up THEN " + _label + " ELSE coalesce(nullif(concat_ws(' ', " + ", ".join(_flip(n, f"d{c}") for n, c in zip(FLAGS, "anr")) + "), ''), '±0') END"


@query("transition_network", f"WITH {EDGE_SQL} SELECT sample_id, model, i, j, l1, kind, penalty, {_label} AS delta_label, {_added} AS addition_label FROM edges")
def transition_network(s, d):
    names = exprs.strings(FLAGS)
    return network.network(nodes(s, d)).select(*BY, "i", "j", "l1", "kind", "penalty", exprs.delta_label(names, F.col("delta")).alias("delta_label"), exprs.addition_label(names, F.col("delta")).alias("addition_label"))


@query("clean_degree", f"WITH {EDGE_SQL} SELECT x.sample_id, x.model, x.peak_id, count(e.i) AS clean_degree FROM nodes x LEFT JOIN (SELECT * FROM edges WHERE kind = 'clean') e ON e.sample_id = x.sample_id AND e.model = x.model AND x.peak_id IN (e.i, e.j) GROUP BY 1, 2, 3")
def clean_degree(s, d):
    return network.clean_degrees(nodes(s, d))


COMPONENT_SQL = EDGE_SQL + """, pairs AS (SELECT i AS x, j AS y FROM edges WHERE kind = 'clean' UNION ALL SELECT j, i FROM edges WHERE kind = 'clean'),
reach AS (SELECT peak_id AS x, peak_id AS y FROM nodes UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
parts AS (SELECT sample_id, model, peak_id, component FROM nodes JOIN (SELECT x AS peak_id, min(y) AS component FROM reach GROUP BY 1) USING (peak_id))"""


@query("clean_components", f"WITH RECURSIVE {COMPONENT_SQL} SELECT * FROM parts")
def clean_components(s, d):
    return network.clean_components(settled(nodes(s, d)))


def _statistics(s, d):
    own = settled(nodes(s, d))
    return own, network.network_statistics(own, None, network.clean_components(own))


STATISTICS_SQL = f"""{COMPONENT_SQL}, sz AS (SELECT sample_id, model, count(*) AS n_good FROM nodes GROUP BY 1, 2),
kn AS (SELECT sample_id, model, count(*) AS total_pairs, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in network.KINDS)} FROM edges GROUP BY 1, 2),
cp AS (SELECT sample_id, model, count(*) AS clean_components, max(n) AS largest_clean_component FROM (SELECT sample_id, model, component, count(*) AS n FROM parts GROUP BY 1, 2, 3) GROUP BY 1, 2),
ns AS (SELECT sample_id, model, n_good, coalesce(total_pairs, 0) AS total_pairs, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in network.KINDS)}, clean_components, largest_clean_component,
  coalesce(n_clean / total_pairs, 0) AS clean_density, 2 * coalesce(n_clean, 0) / n_good AS mean_clean_degree, largest_clean_component / n_good AS clean_reachability
FROM sz LEFT JOIN kn USING (sample_id, model) JOIN cp USING (sample_id, model))"""
_ROUNDED = "round(clean_density, 6) AS clean_density, round(mean_clean_degree, 6) AS mean_clean_degree, round(clean_reachability, 6) AS clean_reachability"


@query("network_statistics", f"WITH RECURSIVE {STATISTICS_SQL} SELECT * REPLACE ({_ROUNDED}) FROM ns")
def network_statistics(s, d):
    rows = _statistics(s, d)[1]
    return rows.withColumns({c: F.round(c, 6) for c in ("clean_density", "mean_clean_degree", "clean_reachability")})


# An edge is in the tree unless smaller edges join its ends.
TREE_SQL = """smaller AS (SELECT e.i, e.j, x.i AS a, x.j AS b FROM edges e JOIN edges x USING (sample_id, model) WHERE (x.penalty, x.gap, x.i, x.j) < (e.penalty, e.gap, e.i, e.j)),
ways AS (SELECT * FROM smaller UNION ALL SELECT i, j, b, a FROM smaller),
walk AS (SELECT i, j, i AS here FROM edges UNION SELECT walk.i, walk.j, ways.b FROM walk JOIN ways ON ways.i = walk.i AND ways.j = walk.j AND ways.a = walk.here),
tree AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.i = e.i AND w.j = e.j AND w.here = e.j))"""


@query("mst_edges", f"WITH RECURSIVE {EDGE_SQL}, {TREE_SQL} SELECT sample_id, model, i, j, round(gap, 6) AS gap, l1, kind, penalty FROM tree")
def mst_edges(s, d):
    return network.spanning_trees(network.tree_candidates(settled(nodes(s, d)))).select(*BY, "i", "j", F.round("gap", 6).alias("gap"), "l1", "kind", "penalty")


@query("rank_models", f"""WITH RECURSIVE {STATISTICS_SQL}, {TREE_SQL}, ts AS (SELECT sample_id, model, count(*) AS mst_edges, {", ".join(f"count(*) FILTER (kind = '{k}') AS mst_{k}" for k in network.KINDS)}, avg(penalty) AS mst_mean_penalty, max(l1) AS mst_max_l1 FROM tree GROUP BY 1, 2),
joined AS (SELECT ns.*, coalesce(mst_edges, 0) AS mst_edges, {", ".join(f"coalesce(mst_{k}, 0) AS mst_{k}" for k in network.KINDS)}, coalesce(mst_mean_penalty, 0) AS mst_mean_penalty, coalesce(mst_max_l1, 0) AS mst_max_l1 FROM ns LEFT JOIN ts USING (sample_id, model)),
scored AS (SELECT *, mst_mean_penalty * (2 - clean_reachability) * (1 + CASE WHEN mst_edges > 0 THEN mst_mixed / mst_edges ELSE 0 END) AS score FROM joined)
SELECT * REPLACE ({_ROUNDED}, round(mst_mean_penalty, 6) AS mst_mean_penalty, round(score, 6) AS score), row_number() OVER (PARTITION BY sample_id ORDER BY score, n_good DESC, model)::INT AS rank FROM scored""")
def rank_models(s, d):
    own, stats = _statistics(s, d)
    ranked = network.rank_models(stats, network.tree_statistics(network.spanning_trees(network.tree_candidates(own))))
    return ranked.withColumns({c: F.round(c, 6) for c in ("clean_density", "mean_clean_degree", "clean_reachability", "mst_mean_penalty", "score")})


PARENT_SQL = """p AS (
  SELECT y.sample_id, y.model, y.peak_id, x.peak_id AS parent, false AS rooted, x.observed AS mass, y.a - x.a AS da, y.n - x.n AS dn, y.r - x.r AS dr FROM nodes x JOIN nodes y ON x.sample_id = y.sample_id AND x.model = y.model AND x.a <= y.a AND x.n <= y.n AND x.r <= y.r AND x.a + x.n + x.r < y.a + y.n + y.r
  UNION ALL SELECT sample_id, model, peak_id, 0, true, 0.0, a, n, r FROM nodes),
k AS (SELECT *, da + dn + dr AS l1, CASE WHEN da + dn + dr = 0 THEN 2.0 ELSE da + dn + dr - 1.0 END AS penalty FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, model, peak_id ORDER BY l1, penalty, mass, parent) AS k FROM k)"""


@query("additive_tree_parent", f"WITH {NODES_SQL}, {PARENT_SQL} SELECT sample_id, model, peak_id, parent, da || ',' || dn || ',' || dr AS delta FROM o WHERE k = 1")
def additive_tree_parent(s, d):
    return network.additive_parents(settled(nodes(s, d))).select(*BY, "peak_id", "parent", text("delta").alias("delta"))


CHAIN_SQL = f"""{EDGE_SQL}, {PARENT_SQL}, own AS (SELECT o.sample_id, o.model, o.peak_id, parent, rooted, CASE WHEN NOT rooted THEN parent END AS above, da, dn, dr, l1, observed, a, n, r, true AS up FROM o JOIN nodes USING (sample_id, model, peak_id) WHERE k = 1),
paths AS (SELECT peak_id, [{{'m': observed, 'p': peak_id}}] AS path FROM own WHERE rooted UNION ALL SELECT own.peak_id, list_append(path, {{'m': observed, 'p': own.peak_id}}) FROM own JOIN paths ON own.above = paths.peak_id),
kids AS (SELECT above AS peak_id, count(*) AS n_children FROM own WHERE NOT rooted GROUP BY 1),
links AS (SELECT i AS here, j AS nb, da, dn, dr FROM edges WHERE kind = 'clean' UNION ALL SELECT j, i, -da, -dn, -dr FROM edges WHERE kind = 'clean'),
degrees AS (SELECT here AS peak_id, count(*) AS clean_degree FROM links GROUP BY 1),
also AS (SELECT here AS peak_id, string_agg('#' || nb || ' ' || CASE WHEN least(l.da, l.dn, l.dr) < 0 THEN '+' ELSE '-' END || CASE WHEN l.da <> 0 THEN 'A' WHEN l.dn <> 0 THEN 'N' ELSE 'R' END, '; ' ORDER BY y.observed, nb) AS extra_clean
  FROM links l JOIN own x ON x.peak_id = here JOIN own y ON y.peak_id = nb
  WHERE nb IS DISTINCT FROM x.above AND y.above IS DISTINCT FROM here AND NOT (x.l1 = 0 AND x.above IS NOT DISTINCT FROM y.above) AND (-l.da, -l.dn, -l.dr) <> (x.da, x.dn, x.dr) GROUP BY 1)"""


@query("additive_tree_chain", f"""WITH RECURSIVE {CHAIN_SQL} SELECT sample_id, model, row_number() OVER (PARTITION BY sample_id, model ORDER BY path)::INT AS place, peak_id, round(observed, 5) AS mass, len(path)::INT AS depth, parent,
  coalesce(nullif(concat_ws(' ', {', '.join(f"CASE WHEN {c} > 0 THEN '{n}×' || {c} END" for n, c in zip(FLAGS, 'anr'))}), ''), '(empty)') AS formula, coalesce(n_children, 0) AS n_children, coalesce(clean_degree, 0) AS clean_degree,
  {_added} AS addition, {_label} AS transition, CASE WHEN l1 = 0 THEN 'identity' WHEN l1 = 1 THEN 'clean' WHEN (da <> 0)::INT + (dn <> 0)::INT + (dr <> 0)::INT = 1 THEN 'skip' ELSE 'multi' END AS edge_kind, l1::INT AS edge_l1, coalesce(extra_clean, '') AS extra_clean
  FROM own JOIN paths USING (peak_id) LEFT JOIN kids USING (peak_id) LEFT JOIN degrees USING (peak_id) LEFT JOIN also USING (peak_id)""")
def additive_tree_chain(s, d):
    return network.tree_chain(settled(nodes(s, d)), FLAGS).withColumn("extra_clean", F.array_join("extra_clean", "; "))


STEP_SQL = EDGE_SQL + """, pr AS (SELECT x.sample_id, x.model, y.a - x.a AS da, y.n - x.n AS dn, y.r - x.r AS dr FROM nodes x JOIN nodes y ON x.sample_id = y.sample_id AND x.model = y.model AND x.peak_id < y.peak_id),
st AS (SELECT sample_id, model, greatest([da, dn, dr], [-da, -dn, -dr]) AS step, count(*) AS frequency FROM pr WHERE abs(da) + abs(dn) + abs(dr) BETWEEN 1 AND 2 GROUP BY 1, 2, 3)"""


@query("step_frequency", f"WITH {STEP_SQL} SELECT sample_id, model, array_to_string(step, ',') AS step, frequency FROM st")
def step_frequency(s, d):
    return network.step_frequencies(nodes(s, d)).withColumn("step", text("step"))


@query("connectivity_score", f"WITH {STEP_SQL} SELECT sample_id, model, sum(frequency * frequency)::BIGINT AS connectivity FROM st GROUP BY 1, 2")
def connectivity_score(s, d):
    return network.connectivity_scores(nodes(s, d))


# ---- diagnostics --------------------------------------------------------------------------------------------------

_R = "r AS (SELECT l_returnflag AS sample_id, l_extendedprice AS observed, l_quantity * 1500.0 + 10.0 AS reconstructed, l_extendedprice - (l_quantity * 1500.0 + 10.0) AS e FROM lineitem)"


@query("residual_statistics", f"""WITH {_R}, m AS (SELECT sample_id, count(*) AS n, avg(e) AS mean, median(e) AS median, stddev_samp(e) AS std, min(e) AS low, max(e) AS high, avg(observed) AS mx, sum(e * e) AS rss,
  avg(CASE WHEN observed > 0 THEN abs(e) / observed * 1e6 ELSE 0 END) AS ppm_mean, median(CASE WHEN observed > 0 THEN abs(e) / observed * 1e6 ELSE 0 END) AS ppm_median, max(CASE WHEN observed > 0 THEN abs(e) / observed * 1e6 ELSE 0 END) AS ppm_max FROM r GROUP BY 1),
c AS (SELECT sample_id, sum(pow(e - mean, 3)) AS s3, sum(pow(e - mean, 4)) AS s4, sum((observed - mx) * (e - mean)) AS sxy, sum(pow(observed - mx, 2)) AS sxx, sum(pow(e - mean, 2)) AS syy FROM r JOIN m USING (sample_id) GROUP BY 1)
SELECT sample_id, n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(low, 4) AS low, round(high, 4) AS high, round(s3 / n / pow(std, 3), 4) AS skewness, round(s4 / n / pow(std, 4) - 3, 4) AS kurtosis,
  round(sxy / sxx, 6) AS slope, round(mean - sxy / sxx * mx, 3) AS intercept, round(greatest(1 - (syy - sxy * sxy / sxx) / syy, 0), 6) AS line_r2, abs(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) > 2 AS biased,
  round(ppm_mean, 3) AS ppm_mean, round(ppm_median, 3) AS ppm_median, round(ppm_max, 3) AS ppm_max, round(greatest(1 - rss / sxx, 0), 6) AS r2 FROM m JOIN c USING (sample_id)""")
def residual_statistics(s, d):
    digits = {"slope": 6, "intercept": 3, "line_r2": 6, "r2": 6, "ppm_mean": 3, "ppm_median": 3, "ppm_max": 3}
    rows = diagnostics.residual_statistics(residuals(s, d), ["sample_id"])
    return rows.withColumns({c: F.round(c, digits.get(c, 4)) for c, t in rows.dtypes if t == "double"})


@query("residual_normality")
def residual_normality(s, d):
    return diagnostics.normality(residuals(s, d), ["sample_id"])


_EACH = f"{NODES_SQL}, each AS (SELECT sample_id, model, b, c FROM nodes, unnest(['A', 'N', 'R']) t(b), LATERAL (SELECT CASE b WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END AS c))"


@query("block_usage", f"WITH {_EACH} SELECT sample_id, model, b AS block, count(*) AS n_good, count(*) FILTER (c > 0) AS n_used, round(coalesce(avg(c) FILTER (c > 0), 0), 6) AS mean_copies, max(c) AS max_copies, round(count(*) FILTER (c > 0) / count(*), 6) AS share, count(*) FILTER (c > 0) <= 2 AND count(*) > 5 AS flagged FROM each GROUP BY 1, 2, 3")
def block_usage(s, d):
    return diagnostics.usage_by_block(nodes(s, d), BY, FLAGS).drop("ord").withColumns({c: F.round(c, 6) for c in ("mean_copies", "share")})


@query("block_cooccurrence", f"WITH {NODES_SQL} SELECT sample_id, model, 'A' AS block_a, 'N' AS block_b, count(*) AS n_peaks FROM nodes WHERE a > 0 AND n > 0 GROUP BY 1, 2 UNION ALL SELECT sample_id, model, 'A', 'R', count(*) FROM nodes WHERE a > 0 AND r > 0 GROUP BY 1, 2 UNION ALL SELECT sample_id, model, 'N', 'R', count(*) FROM nodes WHERE n > 0 AND r > 0 GROUP BY 1, 2")
def block_cooccurrence(s, d):
    return diagnostics.cooccurrence(nodes(s, d), BY, FLAGS)


@query("blocks_per_peak", f"WITH {NODES_SQL}, k AS (SELECT sample_id, model, (a > 0)::INT + (n > 0)::INT + (r > 0)::INT AS k FROM nodes) SELECT sample_id, model, round(avg(k), 6) AS mean_blocks, max(k) AS max_blocks, count(*) FILTER (k = 0) AS common_only FROM k GROUP BY 1, 2")
def blocks_per_peak(s, d):
    return diagnostics.blocks_per_peak(nodes(s, d), BY).withColumn("mean_blocks", F.round("mean_blocks", 6))


# ---- scalars and text ---------------------------------------------------------------------------------------------


@query("common_mass", f"""SELECT c_custkey, round((c_custkey % 6)::INT * {MASSES[0]!r} + (c_custkey % 4)::INT * {MASSES[1]!r} + 137.047679 + CASE c_nationkey % 4 WHEN 0 THEN -1.00784 WHEN 1 THEN 22.989769 WHEN 2 THEN 1.00784 ELSE 0 END
  + CASE WHEN c_acctbal > 0 THEN -2 * 1.00784 ELSE 0 END, 6)::DOUBLE AS mass FROM customer""")
def common_mass(s, d):
    """Of a composition, mode and reduction for each customer; one of its blocks and one of the modes are unknown."""
    book = {r["name"]: r.mass for r in dictionary.blocks(s).collect()}
    label = next(r.mass for r in dictionary.labels(s).collect() if r["name"] == "2-AA")
    counts = F.array((F.col("c_custkey") % 6).cast("int"), (F.col("c_custkey") % 4).cast("int"), F.lit(9))
    mode = F.get(F.array(*map(F.lit, ("neg_h", "pos_na", "pos_h", "other"))), F.col("c_nationkey") % 4)
    mass = exprs.common_masses(exprs.strings(("Hex", "HexNAc", "nothing")), counts, book, label, mode, F.when(F.col("c_acctbal") > 0, "r").otherwise("nr"))
    return read(s, d, "customer").select("c_custkey", F.round(mass, 6).alias("mass"))


@query("nearest_multiples", f"SELECT p_partkey, round(round_even(p_retailprice / {MASS_UNIT}, 0) * {MASS_UNIT}, 6) AS multiple, round(abs(p_retailprice - round_even(p_retailprice / {MASS_UNIT}, 0) * {MASS_UNIT}), 6) AS distance FROM part")
def nearest_multiples(s, d):
    price = F.col("p_retailprice")
    return read(s, d, "part").select("p_partkey", F.round(exprs.nearest_multiple(price), 6).alias("multiple"), F.round(exprs.multiple_distance(price), 6).alias("distance"))


@query("tag_attr_parse", """SELECT page_id, k AS place, found[k] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS found FROM pages), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS k)""")
def tag_attr_parse(s, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return read(s, d, "pages").select("page_id", F.posexplode(found).alias("p", "href")).select("page_id", (F.col("p") + 1).cast("long").alias("place"), "href")


@query("lenient_number_parse", r"""SELECT event_id, coalesce(try_cast(trim(l) AS DOUBLE), list_filter(list_transform(regexp_split_to_array(trim(l), '[\t,; ]+'), lambda t: try_cast(t AS DOUBLE)), lambda v: v IS NOT NULL)[1], try_cast(nullif(regexp_extract(l, '[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?'), '') AS DOUBLE)) AS value
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN event_type || '; ' || value ELSE value::VARCHAR END AS l FROM events)""")
def lenient_number_parse(s, d):
    line = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit("; "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return read(s, d, "events").select("event_id", lenient_value(F.trim(line)).alias("value"))


# ---- fits and consensus by search ---------------------------------------------------------------------------------


@query("phase_fit")
def phase_fit(s, d):
    rows = fit.spectra(nation_peaks(s, d)).select("sample_id", F.lit(0).alias("trial"), "observed", exprs.doubles(MASSES[:3]).alias("start"), F.lit(2).alias("n_known"), F.lit(COMMON).alias("start_common"))
    out = fit.run_trials(rows, fit.FitConfig())
    return out.select("sample_id", F.round("bic", 4).alias("bic"), "n_good", "n_bad", F.array_join(F.transform("masses", lambda m: F.format_string("%.4f", m)), ",").alias("masses"), F.round("common", 4).alias("common"))


def _annealing(s, d):
    return settled(lattice.within(nation_peaks(s, d), MASSES, LIMITS, COMMON, TOLERANCE))


@query("sa_consensus2")
def sa_consensus2(s, d):
    return consensus.annealed_consensus(_annealing(s, d), TOLERANCE).withColumn("composition", text())


@query("sa_consensus3")
def sa_consensus3(s, d):
    masks = lattice.subset_masks(s, NAMES)
    fits = lattice.closest(nation_peaks(s, d), MASSES, LIMITS, COMMON, masks)
    used = dependencies.block_usage_across_models(fits, len(NAMES), TOLERANCE)
    return consensus.annealed_consensus(consensus.with_dependencies(_annealing(s, d), used), TOLERANCE, consensus.DEPENDENCY_WEIGHT).withColumn("composition", text())


@query("progressive_solve")
def progressive_solve(s, d):
    return solve(nation_peaks(s, d), SolveConfig(mode="neg_h", matrix="2aa_nr", names=NAMES[:2]))["models"].drop("blocks")
