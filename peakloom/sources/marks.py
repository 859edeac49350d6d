"""Peak lists of any size from .msd files (S2, S4): files are read in byte ranges, not whole.

The text source cuts a file into records that end with >, so a record ends with one tag and Spark may read a file's ranges in many tasks. A record's place is
its range's start and its row in the range; peaks are numbered by the counts of the ranges before theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import settled


def _tags(spark: SparkSession, path: str, name: Column | None) -> DataFrame:
    """(sample_id, start, row, tag): the text up to each >, without it."""
    rows = spark.read.option("lineSep", ">").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0) if name is None else name
    return rows.select(name.alias("sample_id"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("tag"))


def msd_peaks(spark: SparkSession, path: str, strict: bool = True, name: Column | None = None) -> DataFrame:
    """(sample_id, peak_id, observed): mz of each <peak> of the first <peaklist> of each file. name: the sample, of the file's _metadata; else the file's name.

    Strict: names in lower case, and a file without that section or with a bad mz fails the read. Lenient: names in any case, a bad mz is skipped, and a file without the section has no
    peaks. A <peak> without mz is none. Only tags that open or close the section or have a peak are kept.
    """
    case = "" if strict else "(?i)"
    tag = F.col("tag")
    opens, closes = F.rlike(tag, F.lit(f"{case}<peaklist$")), F.rlike(tag, F.lit(f"{case}</peaklist$"))
    mz = F.regexp_extract(F.regexp_extract(tag, rf"{case}(?s)<peak\s+(.+)", 1), rf'{case}\bmz="([^"]+)"', 1)
    marked = _tags(spark, path, name).withColumns({"opens": opens, "closes": closes, "mz": mz})
    files = marked.select("sample_id").distinct() if strict else None
    kept = settled(marked.where("opens or closes or mz <> ''").drop("tag"))
    place = F.struct("start", "row")
    first = kept.where("opens").groupBy("sample_id").agg(F.min(place).alias("from"))
    if strict:
        bad = files.join(_sections(kept, first), "sample_id", "left_anti").limit(1).collect()
        if bad:
            raise ValueError(f"no peaklist in {bad[0][0]}")
    inside = kept.join(_sections(kept, first), "sample_id").where((place > F.col("from")) & (place <= F.col("to")) & (F.col("mz") != ""))
    value = F.col("mz").try_cast("double")
    if strict:
        value = F.coalesce(value, F.raise_error(F.concat(F.lit("not a mass: "), F.col("mz"))).cast("double"))
    values = settled(inside.select("sample_id", "start", "row", value.alias("observed")).where("observed is not null"))
    counts = values.groupBy("sample_id", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sample_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("sample_id", "start").orderBy("row"))  # within a range of bytes
    rows = values.withColumn("turn", turn).join(counts.select("sample_id", "start", before.alias("before")), ["sample_id", "start"])
    return rows.select("sample_id", (F.col("before") + F.col("turn")).alias("peak_id"), "observed")


def _sections(kept: DataFrame, first: DataFrame) -> DataFrame:
    """(sample_id, from, to): the first opening tag, and the first closing tag behind it."""
    place = F.struct("start", "row")
    return kept.where("closes").join(first, "sample_id").where(place > F.col("from")).groupBy("sample_id").agg(F.first("from").alias("from"), F.min(place).alias("to"))
