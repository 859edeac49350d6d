"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every operator here splits words at it and at nothing else.
WS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session gets a temporary one, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='peakloom-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/peakloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that more than one row in HOT has are fewer than HOT, whatever the input.
HOT = 10_000


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int, wanted: Column | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner; left keeps all rows, for sides all wanted) with the wanted rows of side, unique by keys; weight is the column of side that says how many of all total rows have the key.

    Hot keys, fewer than HOT, are broadcast, so that their rows stay where they are; rows of other keys meet side by a shuffle, at most total / HOT for each key.
    """
    wanted = F.lit(True) if wanted is None else wanted
    hot = F.col(weight) * F.lit(HOT) > F.lit(total)
    warm = side.where(hot)
    met = rows.join(F.broadcast(warm.where(wanted)), keys)
    rest = rows.join(F.broadcast(warm.select(*keys)), keys, "left_anti")
    return met.unionByName(rest.join(side.where(~hot & wanted), keys, how))


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only. lower() agrees wherever every character is one byte."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
