"""Cutting the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str = "rows") -> str:
    """The path of a new folder in spark.checkpoint.dir, which driver and executors share. Where none is configured, a local session gets
    a temporary folder, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='peakloom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/peakloom-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet into a new shared folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
