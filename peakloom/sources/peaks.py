"""Peak lists from files and text: (sample_id, peak_id, observed); peak_id counts from 1 in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0).alias("sample_id"), F.col("value").alias("content"))


def _numbered(rows: DataFrame, found: Column) -> DataFrame:
    """found: array of values in order, nulls left out."""
    kept = F.filter(found, lambda v: v.isNotNull())
    return rows.select("sample_id", F.posexplode(kept).alias("p", "observed")).select("sample_id", (F.col("p") + 1).alias("peak_id"), F.col("observed").cast("double").alias("observed"))


def _lines(content: Column) -> Column:
    lines = F.transform(F.split(content, r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f")))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


def text_peaks(spark: SparkSession, path: str) -> DataFrame:
    """A number a line; blank and # lines skipped; any other line fails the read."""
    rows = _files(spark, path)
    return _numbered(rows, F.transform(_lines(F.col("content")), lambda x: F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a peak: "), x)).cast("double"))))


def lenient_value(line: Column) -> Column:
    """S3: the whole line, else the first token that is a number, else the first number in it."""
    tokens = F.transform(F.split(line, r"[\t,; ]+"), lambda t: t.try_cast("double"))
    return F.coalesce(line.try_cast("double"), F.get(F.filter(tokens, lambda v: v.isNotNull()), 0), F.regexp_extract(line, NUMBER, 0).try_cast("double"))


def lenient_text_peaks(contents: DataFrame) -> DataFrame:
    """S3 over (sample_id, content)."""
    return _numbered(contents, F.transform(_lines(F.col("content")), lenient_value))


def _msd_values(content: Column) -> Column:
    section = F.regexp_extract(content, r"(?is)<peaklist>(.*?)</peaklist>", 1)
    marks = F.regexp_extract_all(section, F.lit(r"(?is)<peak\b[^>]*>"), F.lit(0))
    return F.transform(marks, lambda m: F.regexp_extract(m, r'(?i)\bmz="([^"]+)"', 1))


def msd_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Mz of each <peak> inside <peaklist>; a file without that section or with a bad mz fails the read."""
    rows = _files(spark, path)
    section = F.when(F.rlike("content", F.lit(r"(?s)<peaklist>.*?</peaklist>")), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no peaklist in "), F.col("sample_id"))).cast("string"))
    values = F.transform(F.filter(_msd_values(section), lambda m: m != ""), lambda m: F.coalesce(m.try_cast("double"), F.raise_error(F.concat(F.lit("not a mass: "), m)).cast("double")))
    return _numbered(rows, values)


def lenient_msd_peaks(contents: DataFrame) -> DataFrame:
    """Bad mz skipped; no section, no peaks."""
    return _numbered(contents, F.transform(_msd_values(F.col("content")), lambda m: m.try_cast("double")))


def uploaded_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Any files; UTF-8, else Latin-1; .msd files by S4, others by S3."""
    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.is_valid_utf8(F.col("content"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = raw.select(F.regexp_extract("path", r"[^/]+$", 0).alias("sample_id"), text.alias("content"))
    msd = F.lower("sample_id").endswith(".msd")
    return lenient_msd_peaks(rows.where(msd)).unionByName(lenient_text_peaks(rows.where(~msd)))


def pasted_lines(text: str | None, uploaded: str | None = None) -> str | None:
    """Pasted text beats an upload; blank and # lines go; null without any line."""
    for source in (text, uploaded):
        lines = [x.strip() for x in (source or "").splitlines()]
        lines = [x for x in lines if x and not x.startswith("#")]
        if lines:
            return "\n".join(lines) + "\n"
    return None


def with_sniffed_mode(peaks: DataFrame) -> DataFrame:
    """Polarity and label read from an .msd file's name; null where it says nothing."""
    name = F.col("sample_id")
    msd = F.lower(name).endswith(".msd")
    mode = F.when(msd & F.rlike(name, F.lit("LN_|RN_")), "neg_h").when(msd & F.rlike(name, F.lit("LP_|RP_")), "pos_na")
    return peaks.withColumns({"mode": mode, "matrix": F.when(msd & F.contains(F.lower(name), F.lit("_2aa")), "2aa_nr")})
