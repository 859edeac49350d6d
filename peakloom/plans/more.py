"""Further registered queries: readers, single expressions over whole tables, and layouts of the result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import candidates, compare, consensus, diagnostics, lattice, network
from ..operators.storage import new_folder
from ..sources import dictionary, marks
from ..streaming import log
from .catalog import BY, COMMON, DICT_SQL, EDGE_SQL, LATTICE_SQL, MODELS_SQL, PEAK_SQL, TOLERANCE, WIDE, _models, _peak_stats, query, text
from .tables import FLAGS, LIMITS, MASSES, NAMES, NODES_SQL, nodes, peaks, read



def _written(s, rows, name):
    """Lines (line) as text files."""
    path = new_folder(s, name)
    rows.select("line").write.text(path)
    return path


def _part_dictionary(s, d):
    """The parts as dictionary files, with comments, meta rows, bad masses and missing limits."""
    key, rows = F.col("p_partkey"), read(s, d, "part")
    name = F.when(key % 7 == 0, "_free_red_end").otherwise(F.col("p_name"))
    mass = F.when(key % 13 == 0, "x").otherwise(F.col("p_retailprice").cast("string"))
    category = F.when(key % 7 == 0, "meta").when(key % 3 == 0, "common").otherwise("Rare")
    limit = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws("\t", name, mass, category, limit, "p_brand", "p_type")
    return _written(s, rows.select(F.when(key % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("line")), "dictionary")


_PARTS = "FROM part WHERE p_partkey % 11 <> 0"


@query("block_dictionary", f"SELECT p_name AS name, p_retailprice AS mass, CASE WHEN p_partkey % 3 = 0 THEN 'common' ELSE 'rare' END AS category, CASE WHEN p_size % 3 <> 0 THEN p_size WHEN p_partkey % 3 = 0 THEN 10 ELSE 4 END AS max_limit, p_brand AS glycan_type, p_type AS full_name {_PARTS} AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0")
def block_dictionary(s, d):
    return dictionary.blocks(s, _part_dictionary(s, d), glycan_type=None, sep="\t").drop("ord")


@query("free_reducing_ends", f"SELECT p_brand AS glycan_type, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS mass {_PARTS} AND p_partkey % 7 = 0")
def free_reducing_ends(s, d):
    return dictionary.free_reducing_ends(s, _part_dictionary(s, d))


@query("label_table", "SELECT s_name AS name, s_acctbal AS mass, CASE WHEN s_suppkey % 2 = 0 THEN 'nation ' || s_nationkey ELSE '' END AS description FROM supplier WHERE s_suppkey % 5 <> 0")
def label_table(s, d):
    key = F.col("s_suppkey")
    full = F.concat_ws("\t", "s_name", F.col("s_acctbal").cast("string"), F.when(key % 2 == 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))))
    return dictionary.labels(s, _written(s, read(s, d, "supplier").select(F.when(key % 5 == 0, F.col("s_name")).otherwise(full).alias("line")), "labels")).drop("ord")


_NEAREST = f"f AS (SELECT sample_id, peak_id, observed, min({{'error': abs((observed - {COMMON!r}::DOUBLE) - mass), 'copies': copies, 'comp': comp, 'mass': mass}}) AS f FROM peaks, lat GROUP BY 1, 2, 3)"


@query("reconstruction", f"WITH {LATTICE_SQL}, {_NEAREST} SELECT sample_id, peak_id, round({COMMON!r}::DOUBLE + f.mass + 1e-8, 5) AS reconstructed, round(abs(observed - ({COMMON!r}::DOUBLE + f.mass)) + 1e-8, 5) AS error, CASE WHEN abs(observed - ({COMMON!r}::DOUBLE + f.mass)) < {WIDE} THEN 'GOOD' ELSE 'BAD' END AS status FROM f")
def reconstruction(s, d):
    rows = lattice.reconstructed(lattice.closest(peaks(s, d), MASSES, LIMITS, COMMON), MASSES, COMMON, WIDE)
    return rows.select("sample_id", "peak_id", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("reconstructed", "error")], "status")


@query("good_peaks", f"WITH {LATTICE_SQL}, {_NEAREST} SELECT sample_id, peak_id FROM f WHERE abs(observed - ({COMMON!r}::DOUBLE + f.mass)) < {WIDE}")
def good_peaks(s, d):
    return diagnostics.good(lattice.reconstructed(lattice.closest(peaks(s, d), MASSES, LIMITS, COMMON), MASSES, COMMON, WIDE)).select("sample_id", "peak_id")


@query("model_order", f"WITH {MODELS_SQL} SELECT sample_id, mask, model, row_number() OVER (PARTITION BY sample_id ORDER BY n_blocks, bic NULLS LAST, mask)::INT AS place FROM models")
def model_order(s, d):
    return compare.model_order(_models(s, d)[1]).select("sample_id", "mask", "model", "place")


@query("adjusted_bic", f"WITH {MODELS_SQL} SELECT sample_id, mask, round(bic + 2 * n * ln(300.0::DOUBLE / {MASSES[2]!r}) + 2 * n * ln(300.0::DOUBLE / {MASSES[3]!r}), 4) AS adjusted FROM models")
def adjusted_bic(s, d):
    return _models(s, d)[1].select("sample_id", "mask", F.round(exprs.adjusted_bic(F.col("bic"), F.col("n"), exprs.doubles(MASSES[2:])), 4).alias("adjusted"))


@query("residual_multiples", f"SELECT p_partkey, round_even((p_retailprice - 900) / {MASSES[0]!r}, 0) >= 1 AND abs((p_retailprice - 900) - round_even((p_retailprice - 900) / {MASSES[0]!r}, 0) * {MASSES[0]!r}) < 5.0 AS multiple FROM part")
def residual_multiples(s, d):
    return read(s, d, "part").select("p_partkey", exprs.is_multiple(F.col("p_retailprice") - 900, F.lit(MASSES[0]), 5.0).alias("multiple"))


@query("count_parse", "SELECT event_id, coalesce(trunc(try_cast(CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN value::VARCHAR ELSE event_type END AS DOUBLE))::INT, 0) AS n FROM events")
def count_parse(s, d):
    cell = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise(F.col("event_type"))
    return read(s, d, "events").select("event_id", exprs.block_count(cell).alias("n"))


@query("job_names", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}\-_.]', '_', 'g') AS name FROM pages")
def job_names(s, d):
    return read(s, d, "pages").select("page_id", exprs.job_name(F.col("url")).alias("name"))


@query("model_labels", f"WITH {NODES_SQL} SELECT peak_id, concat_ws('+', CASE WHEN r > 0 THEN 'R' END, CASE WHEN a > 0 THEN 'A' END, CASE WHEN n > 0 THEN 'N' END) AS label FROM nodes")
def model_labels(s, d):
    """The blocks of each node's composition as a label, in another order of blocks, one of which is unknown."""
    used = F.array_join(F.filter(F.zip_with(exprs.strings(FLAGS), "composition", lambda b, n: F.when(n > 0, b)), lambda b: b.isNotNull()), "+")
    return nodes(s, d).select("peak_id", exprs.reordered_label(used, exprs.strings(("R", "A"))).alias("label"))


@query("masked_counts", f"WITH {NODES_SQL} SELECT peak_id, a || ',0,' || r AS composition FROM nodes")
def masked_counts(s, d):
    return nodes(s, d).select("peak_id", F.array_join(exprs.masked(F.col("composition"), F.array(F.lit("A"), F.lit("R")), exprs.strings(FLAGS)).cast("array<string>"), ",").alias("composition"))


@query("resolved_masses", f"""WITH {DICT_SQL}, d AS (SELECT lower(name) AS key, arg_min(mass, ord) AS mass FROM dict GROUP BY 1),
t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['hex', ' KDN ', 'HexNAc', 'nothing'][p_size % 4 + 1] WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN p_name END AS token FROM part)
SELECT p_partkey, coalesce(d.mass, try_cast(trim(token) AS DOUBLE)) AS mass FROM t LEFT JOIN d ON key = lower(trim(token))""")
def resolved_masses(s, d):
    key, known = F.col("p_partkey"), F.array(*map(F.lit, ("hex", " KDN ", "HexNAc", "nothing")))
    token = F.when(key % 4 == 0, F.get(known, F.col("p_size") % 4)).when(key % 4 == 1, F.col("p_retailprice").cast("string")).when(key % 4 == 2, F.col("p_name"))
    return candidates.resolved_masses(read(s, d, "part").select("p_partkey", token.alias("token")), dictionary.blocks(s)).select("p_partkey", "mass")


@query("overridden_best", f"""WITH {PEAK_SQL}, n AS (SELECT sample_id, peak_id, min({{'error': abs((observed - {COMMON!r}::DOUBLE) - mass), 'copies': copies, 'comp': comp}}) AS f FROM peaks, lat GROUP BY 1, 2)
SELECT sample_id, peak_id, CASE WHEN f.error < {TOLERANCE} THEN 'BioConsensus3' ELSE best.model END AS best_model, array_to_string(CASE WHEN f.error < {TOLERANCE} THEN f.comp ELSE best.comp END, ',') AS best_composition FROM ps JOIN n USING (sample_id, peak_id)""")
def overridden_best(s, d):
    rows = consensus.overridden(lattice.closest(_peak_stats(s, d), MASSES, LIMITS, COMMON), TOLERANCE)
    return rows.select("sample_id", "peak_id", "best_model", text("best_composition").alias("best_composition"))


@query("typed_block_usage", f"WITH {NODES_SQL}, each AS (SELECT sample_id, model, b, CASE b WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END AS c FROM nodes, unnest(['A', 'N', 'R']) t(b)) SELECT sample_id, model, b AS block, count(*) FILTER (c > 0) AS n_used, CASE b WHEN 'A' THEN 1.5 WHEN 'N' THEN 2.5 END::DOUBLE AS mass, CASE b WHEN 'N' THEN 'discovered' ELSE 'known' END AS type FROM each GROUP BY 1, 2, 3")
def typed_block_usage(s, d):
    blocks = s.createDataFrame([("A", 1.5, "known"), ("N", 2.5, "discovered")], "name string, value double, type string")
    return diagnostics.usage_by_block(nodes(s, d), BY, FLAGS, blocks).select(*BY, "block", "n_used", "mass", "type")


@query("clean_edges", f"WITH {EDGE_SQL} SELECT sample_id, model, i AS at, j AS nb FROM edges WHERE kind = 'clean' UNION ALL SELECT sample_id, model, j, i FROM edges WHERE kind = 'clean'")
def clean_edges(s, d):
    return network.clean_pairs(nodes(s, d)).select(*BY, "at", "nb")


@query("usage_log", "SELECT event_type AS kind, count(*) AS n, count(*) AS n_ids, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def usage_log(s, d):
    """The events as a stream into the log, read back; the first batch is written twice, as after a failure."""
    path = new_folder(s, "usage")
    shown = lambda df: df.select(F.col("event_type").alias("kind"), "ts")
    whole = read(s, d, "events")
    log.append_stream(shown(s.readStream.schema(whole.schema).parquet(f"{d}/events.parque[t]")), f"{path}/log", f"{path}/checkpoint", writer=1).awaitTermination()
    log.write_batch(shown(whole), f"{path}/log", 1, 0)
    return log.committed(s, f"{path}/log").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("msd_page_peaks", "SELECT 'm' || page_id % 4 AS sample_id, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS peak_id, length(html) / 8 AS observed FROM pages")
def msd_page_peaks(s, d):
    """The lengths of the pages as .msd files, four of any size, read back in byte ranges."""
    path = new_folder(s, "msd")
    pages = read(s, d, "pages").select(F.concat(F.lit("m"), F.col("page_id") % 4).alias("f"), F.col("page_id").cast("long").alias("k"), F.concat(F.lit('<peak charge="1" mz="'), (F.length("html") / 8).cast("string"), F.lit('"/>')).alias("value"))
    names = pages.select("f").distinct()
    edge = lambda k, tag: names.select("f", F.lit(k).cast("long").alias("k"), F.lit(tag).alias("value"))
    rows = pages.unionByName(edge(-1, "<scan><peaklist>")).unionByName(edge(2**62, "</peaklist></scan>"))
    rows.repartition("f").sortWithinPartitions("f", "k").select("f", "value").write.partitionBy("f").text(path)
    return marks.msd_peaks(s, path, name=F.regexp_extract(F.col("_metadata.file_path"), "/f=([^/]+)/", 1))
