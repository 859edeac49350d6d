"""Readers of the files that sinks write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import block_count

# Columns of results files that are not blocks.
FIXED = (
    "Peak_ID", "Observed", "Model", "Model_Blocks", "Model_BIC", "Reconstructed", "Reconstructed_Theoretical", "Error", "Status", "Formula", "Structure",
    "N_Models_Tested", "N_Models_Explaining", "Composition_Consistent", "Best_Model", "Best_Formula", "Best_Structure",
)


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with a header, all strings, empty fields as they are."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, nullValue="\u0000", emptyValue="", quote="")


def results(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The fact table (model, peak_id, observed, reconstructed, error, status, model_bic, composition) and the block names.

    Columns that are not fixed are blocks. A file without a Model column is one model, named single, without BIC.
    """
    raw = raw_table(spark, path)
    names = [c for c in raw.columns if c not in FIXED]
    model = F.col("Model") if "Model" in raw.columns else F.lit("single")
    bic = F.col("Model_BIC").try_cast("double") if "Model_BIC" in raw.columns else F.lit(None).cast("double")
    number = lambda c: F.col(c).try_cast("double").alias(c.lower())
    facts = raw.select(
        model.alias("model"), F.col("Peak_ID").try_cast("int").alias("peak_id"), number("Observed"), number("Reconstructed"), number("Error"),
        F.trim("Status").alias("status"), bic.alias("model_bic"), F.array(*[block_count(F.col(f"`{b}`")) for b in names]).alias("composition"),
    )
    return facts, names


def fitted_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Name, value, type; the row named common (any case) is left out."""
    rows = raw_table(spark, path)
    return rows.where(F.lower("Block") != "common").select(F.col("Block").alias("name"), F.col("Value").try_cast("double").alias("value"), F.col("Type").alias("type"))


def active_candidates(spark: SparkSession, path: str, dictionary: DataFrame, window: float = 0.5) -> DataFrame:
    """ACTIVE rows, named by the first dictionary entry in file order within the window."""
    from ..operators.candidates import named_by_mass

    rows = raw_table(spark, path).where(F.col("Status") == "ACTIVE")
    rows = rows.select(F.monotonically_increasing_id().alias("rank"), F.col("Median").try_cast("double").alias("mass"), F.col("Score").try_cast("double").alias("score"), F.col("Size").try_cast("int").alias("size"))
    return named_by_mass(rows, dictionary, window)


def dependency_edges(spark: SparkSession, path: str) -> DataFrame:
    """(prerequisite, block, block_order) from block_dependencies.tsv."""
    rows = raw_table(spark, path).where(~F.col("Direct_Dependencies").isin("", "(none)", "(root)"))
    return rows.select(F.explode(F.split("Direct_Dependencies", r"\+")).alias("prerequisite"), F.col("Block").alias("block"), F.col("Biosynthetic_Order").try_cast("int").alias("block_order"))
