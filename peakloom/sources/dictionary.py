"""The block dictionary and labels as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import BLOCKS_TSV, LABELS_TSV


def _lines(spark: SparkSession, path: str | None, bundled: str) -> DataFrame:
    """(ord, line): trimmed lines in file order without comments."""
    if path is None:
        rows = spark.createDataFrame([(bundled,)], "value string")
    else:
        rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def blocks(spark: SparkSession, path: str | None = None, glycan_type: str | None = "native", sep: str = r"\s+") -> DataFrame:
    """Ord, name, mass, category, max_limit, glycan_type, full_name, without meta rows and rows of bad mass.

    Columns are split at white space (S7, S8) or, with sep="\t", at tabs (S9), which also keeps full names whole. Missing fields: category common,
    type native, limit 10 for common and 4 for others. glycan_type None reads all types.
    """
    part = F.split("line", sep, 6)
    field = lambda k: F.nullif(F.trim(F.get(part, k)), F.lit(""))
    rows = _lines(spark, path, BLOCKS_TSV).select(
        "ord", field(0).alias("name"), field(1).try_cast("double").alias("mass"), F.lower(F.coalesce(field(2), F.lit("common"))).alias("category"),
        field(3).try_cast("int").alias("max_limit"), F.coalesce(field(4), F.lit("native")).alias("glycan_type"), field(5).alias("full_name"),
    )
    rows = rows.where(F.col("mass").isNotNull() & (F.col("category") != "meta"))
    rows = rows.withColumn("max_limit", F.coalesce("max_limit", F.when(F.col("category") == "common", 10).otherwise(4)))
    return rows if glycan_type is None else rows.where(F.col("glycan_type") == glycan_type)


def one_per_mass(dictionary: DataFrame) -> DataFrame:
    """Where two rows have one mass, the later row's name stands at the earlier row's place."""
    w = Window.partitionBy("mass").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = dictionary.select(*[F.last(c).over(w).alias(c) if c not in ("ord", "mass") else c for c in dictionary.columns], F.min("ord").over(w).alias("first_ord"))
    return last.where(F.col("ord") == F.col("first_ord")).drop("first_ord")


def free_reducing_ends(spark: SparkSession, path: str | None = None) -> DataFrame:
    """glycan_type, mass."""
    part = F.split("line", r"\t")
    rows = _lines(spark, path, BLOCKS_TSV).where(F.get(part, 0) == "_free_red_end")
    return rows.select(F.get(part, 4).alias("glycan_type"), F.get(part, 1).try_cast("double").alias("mass"))


def labels(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Name, mass, description; lines with fewer than two fields are skipped."""
    part = F.split("line", r"\t")
    rows = _lines(spark, path, LABELS_TSV).where(F.size(part) >= 2)
    return rows.select("ord", F.trim(F.get(part, 0)).alias("name"), F.trim(F.get(part, 1)).cast("double").alias("mass"), F.coalesce(F.trim(F.get(part, 2)), F.lit("")).alias("description"))
