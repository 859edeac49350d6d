"""The usage log: an append-only folder of events."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, kind string, ts timestamp"


def events(spark: SparkSession, path: str) -> DataFrame:
    """All events; an empty log where nothing has been recorded."""
    log = spark.createDataFrame([], SCHEMA)
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:  # no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return log


def _claimed(spark: SparkSession, folder: str, id_: int) -> bool:
    """Whether a file of this name could be made in the folder: of several writers, one can."""
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{id_}")
    files = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(claim.getParent())
    if files.getScheme() == "file":
        return spark._jvm.java.io.File(claim.toUri().getPath()).createNewFile()
    try:
        return files.createNewFile(claim)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False


def record(spark: SparkSession, path: str, kind: str) -> None:
    """One event, now in UTC. Ids count from the largest recorded one, each claimed by one writer alone; the event's file is written aside and moved in whole."""
    path = path.rstrip("/")
    last = events(spark, path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    while not _claimed(spark, f"{path}/_ids", last + 1):  # names with _ are no data to Spark
        last += 1
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    spark.createDataFrame([(last + 1, kind, datetime.now(timezone.utc))], SCHEMA).coalesce(1).write.parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    part = files.globStatus(hadoop(f"{staged}/part-*"))[0].getPath()
    if not files.rename(part, hadoop(f"{path}/event-{last + 1}-{part.getName()}")):
        raise OSError(f"cannot move {part} into {path}")
    files.delete(hadoop(staged), True)
