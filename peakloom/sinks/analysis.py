"""All result files of an analysis, over all of its samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import strings
from ..operators import dependencies, diagnostics, network
from ..operators.storage import settled
from . import reports
from .tables import blocks_file, candidates_file, dependencies_file, exhaustive_models, nested_models, network_file, tree_file, write_tsv

BY = ["sample_id", "model"]


def all_blocks(blocks: DataFrame, known: tuple[str, ...]) -> list[str]:
    """Known blocks, then all others that any sample has: names of the dictionary and letters, so the list is bounded."""
    found = {r[0] for r in blocks.select(F.explode("names")).distinct().collect()}
    return [*[n for n in known if n in found], *sorted(found - set(known))]


def aligned(rows: DataFrame, names: list[str], column: str = "composition") -> DataFrame:
    """rows (names, composition, ...) with a composition over the given names, 0 for blocks that a sample lacks."""
    count = lambda b: F.coalesce(F.get(column, F.array_position("names", b).cast("int") - 1), F.lit(0))
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), F.transform(strings(names), count)))


def tree_text(report: DataFrame) -> DataFrame:
    """K7: (sample_id, model, line_no, line), the dependency tree of each sample."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, "", k, line) for s, each in zip(b["sample_id"], b["report"]) for k, line in enumerate([f"Sample {s}", *dependencies.tree_lines(list(each))])]
            yield pd.DataFrame(rows, columns=["sample_id", "model", "line_no", "line"])

    packed = report.groupBy("sample_id").agg(F.collect_list(F.struct("block", "direct_dependencies", "biosynthetic_order")).alias("report"))  # a row of a sample's blocks
    return packed.mapInPandas(lines, f"sample_id {report.schema['sample_id'].dataType.simpleString()}, model string, line_no int, line string")


def write_analysis(tables: dict[str, DataFrame], book: DataFrame, config, output: str) -> list[str]:
    """Writes the files of K2-K13 and returns their names. tables: of solve(); book: the dictionary."""
    blocks = tables["blocks"]
    names = all_blocks(blocks, config.names)
    named = blocks.select("common_name").first()
    common_name = named[0] if named else "Common"
    masses = {r["name"]: r.mass for r in book.collect()}  # a dictionary's rows
    fitted = F.map_from_arrays("names", "masses")
    theoretical = F.array(*[F.lit(masses[n]) if n in masses else F.coalesce(F.try_element_at(fitted, F.lit(n)), F.lit(0.0)) for n in names]) if names else []
    facts = settled(aligned(tables["facts"], names))
    nodes = facts.where(F.col("status") == "GOOD").select(*BY, "peak_id", "observed", "reconstructed", "composition")
    layout = (names, common_name, config.composition, theoretical, config.common)
    stats = aligned(tables["peak_stats"].join(blocks.select("sample_id", "names"), "sample_id"), names, "best_composition")
    report = settled(dependencies.dependency_report(tables["dependencies"].join(blocks.select("sample_id", "names"), "sample_id"), F.col("names")))
    ranked, bics = settled(tables["network"]), facts.select(*BY, "model_bic").distinct()
    edges = settled(network.network(nodes))
    trees = network.spanning_trees(edges)
    residuals = settled(diagnostics.residual_statistics(nodes, BY))
    pairs = settled(diagnostics.cooccurrence(nodes, BY, names))
    files = {
        "candidates.tsv": candidates_file(tables["candidates"], tables["rejected"]),
        "results.tsv": exhaustive_models(facts, stats, *layout) if config.exhaustive else nested_models(facts, *layout).orderBy("sample_id", "Peak_ID", "Model_Blocks"),
        "blocks.tsv": blocks_file(blocks, len(config.masses), masses, common_name, config.common),
        "block_dependencies.tsv": dependencies_file(report),
        "biosynthetic_summary.tsv": network_file(ranked, bics),
        "biosynthetic_tree.tsv": tree_file(network.tree_chain(nodes.drop("reconstructed"), names).withColumn("extra_clean", F.array_join("extra_clean", "; "))),
    }
    texts = {
        "block_dependencies.txt": tree_text(report), "biosynthetic_report.txt": reports.network_report(ranked, edges),
        "diagnostics_report.txt": reports.diagnostics_report(residuals, pairs),
    }
    payloads = {
        "biosynthetic.json": reports.network_payload(ranked, trees, edges),
        "diagnostics.json": reports.diagnostics_payload(residuals, diagnostics.usage_by_block(nodes, BY, names).drop("ord"), diagnostics.blocks_per_peak(nodes, BY), pairs),
    }
    for name, rows in files.items():
        write_tsv(rows, f"{output}/{name}", name == "candidates.tsv")
    for name, rows in texts.items():
        reports.write_lines(rows, f"{output}/{name}")
    for name, rows in payloads.items():
        rows.select("payload").write.mode("overwrite").text(f"{output}/{name}")
    return [*files, *texts, *payloads]
