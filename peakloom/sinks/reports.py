"""JSON payloads and text reports of the analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits of the rounded figures in payloads.
DIGITS = {
    "mean": 6, "median": 6, "std": 6, "low": 6, "high": 6, "skewness": 4, "kurtosis": 4, "slope": 8, "intercept": 6, "line_r2": 4, "ppm_mean": 2, "ppm_median": 2, "ppm_max": 2, "r2": 8,
    "w": 4, "p": 4, "share": 4, "mean_copies": 2, "mean_blocks": 2, "clean_density": 4, "mean_clean_degree": 2, "clean_reachability": 4, "mst_mean_penalty": 4, "score": 4,
}


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, d) for c, d in DIGITS.items() if c in rows.columns})


def network_payload(ranked: DataFrame, trees: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text for each network: statistics, tree edges and clean edges."""
    by = ["sample_id", "model"]
    edge = F.struct("i", "j", "delta", "l1", "kind", "penalty")
    mst = trees.groupBy(*by).agg(F.sort_array(F.collect_list(edge)).alias("mst_edges"))
    clean = edges.where(F.col("kind") == "clean").groupBy(*by).agg(F.sort_array(F.collect_list(edge)).alias("clean_edges"))
    stats = rounded(ranked).select(*by, F.struct(*[c for c in ranked.columns if c not in by]).alias("statistics"))
    rows = stats.join(mst, by, "left").join(clean, by, "left")
    none = F.array().cast(mst.schema["mst_edges"].dataType)
    return rows.select(*by, F.to_json(F.struct("statistics", F.coalesce("mst_edges", none).alias("mst_edges"), F.coalesce("clean_edges", none).alias("clean_edges"))).alias("payload"))


def diagnostics_payload(residuals: DataFrame, usage: DataFrame, per_peak: DataFrame, pairs: DataFrame) -> DataFrame:
    """One JSON text for each model; co-occurrences in falling order."""
    by = ["sample_id", "model"]
    packed = lambda rows, name: rounded(rows).select(*by, F.struct(*[c for c in rows.columns if c not in by]).alias(name))
    blocks = packed(usage, "b").groupBy(*by).agg(F.sort_array(F.collect_list("b")).alias("usage"))
    together = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_peaks")).alias("o"), "block_a", "block_b", "n_peaks"))).alias("x"))
    together = together.select(*by, F.transform("x", lambda x: F.struct(x["block_a"].alias("block_a"), x["block_b"].alias("block_b"), x["n_peaks"].alias("n_peaks"))).alias("cooccurrence"))
    rows = packed(residuals, "residuals").join(blocks, by, "left").join(packed(per_peak, "blocks_per_peak"), by, "left").join(together, by, "left")
    return rows.select(*by, F.to_json(F.struct("residuals", "usage", "blocks_per_peak", "cooccurrence")).alias("payload"))


def network_report(ranked: DataFrame, edges: DataFrame, most_edges: int = 50) -> DataFrame:
    """(sample_id, model, line_no, line): a heading, the figures, and the first clean edges of each network."""
    by = ["sample_id", "model"]
    figures = [F.concat(F.lit("Model "), F.col("model"), F.lit(", rank "), F.col("rank").cast("string"))]
    figures += [F.concat(F.lit(f"  {c}: "), F.col(c).cast("string")) for c in ("n_good", "total_pairs", "n_clean", "n_skip", "n_multi", "n_mixed", "n_identity", "clean_components", "largest_clean_component", "mst_edges", "mst_mean_penalty", "score")]
    edge = F.struct("i", "j", F.format_string("  clean edge %d - %d", "i", "j").alias("line"))
    clean = edges.where(F.col("kind") == "clean").groupBy(*by).agg(F.transform(F.slice(F.sort_array(F.collect_list(edge)), 1, most_edges), lambda e: e["line"]).alias("listed"))
    rows = rounded(ranked).join(clean, by, "left")
    return rows.select(*by, F.posexplode(F.concat(F.array(*figures), F.coalesce("listed", F.array().cast("array<string>")))).alias("line_no", "line"))


def diagnostics_report(residuals: DataFrame, pairs: DataFrame, most_pairs: int = 10) -> DataFrame:
    """(sample_id, model, line_no, line): residual figures and the commonest pairs of blocks of each model."""
    by = ["sample_id", "model"]
    figures = [F.concat(F.lit("Model "), F.col("model"))] + [F.concat(F.lit(f"  {c}: "), F.col(c).cast("string")) for c in residuals.columns if c not in by]
    pair = F.struct((-F.col("n_peaks")).alias("o"), F.format_string("  %s + %s: %d", "block_a", "block_b", "n_peaks").alias("line"))
    top = pairs.groupBy(*by).agg(F.transform(F.slice(F.array_sort(F.collect_list(pair)), 1, most_pairs), lambda p: p["line"]).alias("listed"))
    rows = rounded(residuals).join(top, by, "left")
    return rows.select(*by, F.posexplode(F.concat(F.transform(F.array(*figures), lambda x: F.coalesce(x, F.lit("  (none)"))), F.coalesce("listed", F.array().cast("array<string>")))).alias("line_no", "line"))


def write_lines(report: DataFrame, path: str) -> None:
    """Text files in order of sample, model and line."""
    report.orderBy("sample_id", "model", "line_no").select("line").write.mode("overwrite").text(path)
