"""Result tables in their file layouts, and TSV output.

Layouts take the fact table (sample_id, model, peak_id, observed, composition, reconstructed, error, status, ...) and give string columns; write_tsv
writes one header and one file per partition, or a single file for small reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dot, doubles, formula, merged_structure, strings
from ..operators.candidates import candidate_report


def fixed(c, digits: int = 5) -> Column:
    return F.format_string(f"%.{digits}f", c)


def _block_columns(names: Sequence[str], member: Column | None = None) -> list[Column]:
    """A count for each block; empty where member, the model's blocks, lacks it."""
    cell = lambda i, b: F.get("composition", F.lit(i)).cast("string") if member is None else F.when(F.array_contains(member, b), F.get("composition", F.lit(i)).cast("string")).otherwise("")
    return [cell(i, b).alias(b) for i, b in enumerate(names)]


def _fit_columns(names: Sequence[str], common_name: str, common: dict[str, int], theoretical: Sequence[float], common_mass: float) -> list[Column]:
    return [
        fixed("reconstructed").alias("Reconstructed"), fixed(F.lit(common_mass) + dot(F.col("composition"), doubles(theoretical))).alias("Reconstructed_Theoretical"), fixed("error").alias("Error"),
        F.col("status").alias("Status"), formula(common_name, strings(names), F.col("composition")).alias("Formula"), F.coalesce(merged_structure(common, list(names), F.col("composition")), F.lit("")).alias("Structure"),
    ]


def single_model(facts: DataFrame, names: Sequence[str], common_name: str, common: dict[str, int], theoretical: Sequence[float], common_mass: float) -> DataFrame:
    """K1, P8."""
    return facts.select("sample_id", F.col("peak_id").alias("Peak_ID"), fixed("observed").alias("Observed"), *_fit_columns(names, common_name, common, theoretical, common_mass), *_block_columns(names))


def nested_models(facts: DataFrame, names: Sequence[str], common_name: str, common: dict[str, int], theoretical: Sequence[float], common_mass: float) -> DataFrame:
    """K2: with the model's label, number of blocks and BIC; facts has n_blocks and model_bic, null for consensus models."""
    consensus = F.col("model_bic").isNull()
    member = F.when(consensus, strings(names)).otherwise(F.split("model", r"\+"))
    head = [F.col("peak_id").alias("Peak_ID"), fixed("observed").alias("Observed"), F.col("model").alias("Model"), F.coalesce("n_blocks", F.lit(len(names))).alias("Model_Blocks"), F.when(consensus, "").otherwise(fixed("model_bic", 2)).alias("Model_BIC")]
    return facts.select("sample_id", *head, *_fit_columns(names, common_name, common, theoretical, common_mass), *_block_columns(names, member))


def exhaustive_models(facts: DataFrame, peak_stats: DataFrame, names: Sequence[str], common_name: str, common: dict[str, int], theoretical: Sequence[float], common_mass: float) -> DataFrame:
    """K2 with the peak's statistics; by peak, then models by number of blocks and BIC, missing ones last."""
    best = F.col("best_composition")
    stats = peak_stats.select(
        "sample_id", F.col("peak_id").alias("Peak_ID"), F.col("n_tested").alias("N_Models_Tested"), F.col("n_explaining").alias("N_Models_Explaining"), F.when(F.col("consistent"), "yes").otherwise("no").alias("Composition_Consistent"),
        F.coalesce("best_model", F.lit("(none)")).alias("Best_Model"), F.when(best.isNull(), "").otherwise(formula(common_name, strings(names), best)).alias("Best_Formula"), F.coalesce(merged_structure(common, list(names), best), F.lit("")).alias("Best_Structure"),
    )
    rows = nested_models(facts, names, common_name, common, theoretical, common_mass).join(stats, ["sample_id", "Peak_ID"], "left")
    return rows.orderBy("sample_id", "Peak_ID", "Model_Blocks", F.when(F.col("Model_BIC") == "", float("inf")).otherwise(F.col("Model_BIC").try_cast("double")))


def candidates_file(ranked: DataFrame, rejected: DataFrame) -> DataFrame:
    """K4."""
    rows = candidate_report(ranked, rejected)
    return rows.select("sample_id", fixed("median").alias("Median"), fixed("score").alias("Score"), F.col("size").alias("Size"), fixed("low").alias("Min"), fixed("high").alias("Max"), F.col("status").alias("Status"), F.col("filter_reason").alias("Filter_Reason"), F.col("sample_values").alias("Sample_Values"))


def blocks_file(model: DataFrame, n_known: int, theoretical: dict[str, float], common_name: str, common_mass: float) -> DataFrame:
    """K5: the common row first, then each block, known or discovered. model: (sample_id, names, masses, common)."""
    book = F.create_map(*[F.lit(x) for kv in theoretical.items() for x in kv]) if theoretical else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    each = model.select("sample_id", F.posexplode(F.arrays_zip("names", "masses")).alias("k", "b"))
    rows = each.select("sample_id", (F.col("k") + 1).alias("k"), F.col("b.names").alias("Block"), fixed("b.masses").alias("Value"), fixed(F.coalesce(book[F.col("b.names")], F.col("b.masses"))).alias("Theoretical"), F.when(F.col("k") < n_known, "known").otherwise("discovered").alias("Type"))
    first = model.select("sample_id", F.lit(0).alias("k"), F.lit(common_name).alias("Block"), fixed("common").alias("Value"), fixed(F.lit(common_mass)).alias("Theoretical"), F.lit("fixed").alias("Type"))
    return first.unionByName(rows).orderBy("sample_id", "k").drop("k")


def dependencies_file(report: DataFrame) -> DataFrame:
    """K6."""
    names = {"block": "Block", "prerequisites": "Prerequisites", "direct_dependencies": "Direct_Dependencies", "biosynthetic_order": "Biosynthetic_Order", "n_with": "N_Models_With_Block", "n_used": "N_Models_Used", "n_not_used": "N_Models_Not_Used"}
    return report.orderBy("sample_id", "biosynthetic_order").select("sample_id", *[F.col(c).alias(n) for c, n in names.items()])


def network_file(ranked: DataFrame, bics: DataFrame) -> DataFrame:
    """K8: one row for each model in rank order. bics: (sample_id, model, model_bic)."""
    rows = ranked.join(bics, ["sample_id", "model"], "left")
    columns = [F.col("rank").alias("Rank"), F.col("model").alias("Model"), F.coalesce(fixed("model_bic", 2), F.lit("")).alias("BIC"), F.col("n_good").alias("N_Good"), F.col("total_pairs").alias("Total_Pairs")]
    columns += [F.col(f"n_{k}").alias(f"{k.title()}_Edges") for k in ("clean", "skip", "multi", "mixed", "identity")]
    columns += [fixed("clean_density", 4).alias("Clean_Density"), fixed("mean_clean_degree", 2).alias("Avg_Clean_Degree"), F.col("clean_components").alias("Clean_Components"), F.col("largest_clean_component").alias("Largest_Clean_Comp"), fixed("clean_reachability", 4).alias("Clean_Reachability"), F.col("mst_edges").alias("MST_Edges")]
    columns += [F.col(f"mst_{k}").alias(f"MST_{k.title()}") for k in ("clean", "skip", "multi", "mixed", "identity")]
    return rows.orderBy("sample_id", "rank").select("sample_id", *columns, fixed("mst_mean_penalty", 4).alias("MST_Mean_Penalty"), F.col("mst_max_l1").alias("MST_Max_L1"), fixed("score", 4).alias("Score"))


def tree_file(chain: DataFrame, common_name: str = "Common") -> DataFrame:
    """K9: pre-order, with the virtual root first."""
    rows = chain.select(
        "sample_id", F.col("model").alias("Model"), F.col("place"), F.col("peak_id").alias("Peak_ID"), fixed("mass").alias("Mass"), F.col("formula").alias("Formula"), F.col("depth").alias("Depth"),
        F.col("parent").cast("string").alias("Parent_Peak_ID"), F.col("addition").alias("Addition"), F.col("transition").alias("Full_Transition"), F.col("edge_kind").alias("Edge_Kind"), F.col("edge_l1").cast("string").alias("Edge_L1"), F.col("clean_degree").alias("Clean_Degree"),
    )
    blank = lambda n: F.lit("").alias(n)
    roots = chain.select("sample_id", F.col("model").alias("Model")).distinct().select("sample_id", "Model", F.lit(0).alias("place"), F.lit(0).alias("Peak_ID"), F.lit("0.00000").alias("Mass"), F.lit(common_name).alias("Formula"), F.lit(0).alias("Depth"), blank("Parent_Peak_ID"), blank("Addition"), blank("Full_Transition"), blank("Edge_Kind"), blank("Edge_L1"), F.lit(0).cast("long").alias("Clean_Degree"))
    return roots.unionByName(rows).orderBy("sample_id", "Model", "place").drop("place")


def write_tsv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated with a header; empty strings stay empty."""
    (rows.coalesce(1) if single_file else rows).write.csv(path, sep="\t", header=True, emptyValue="", nullValue="", quote="", mode="overwrite")
