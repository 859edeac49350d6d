"""A usage log that several writers append to, each batch exactly once.

A batch of a writer is a folder of its own, named by both. Spark's writer puts its marker there last, readers look at marked folders only, and a batch that is
written again after a failure takes the place of what it left. So a replayed batch is not counted twice, and writers never touch one folder. An id is made of the batch, the
row's place in it and the writer, hence unique without looking at what others wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.usage import SCHEMA

#: Writers, numbered from 0, and rows that a batch may have.
WRITERS, ROWS = 64, 2**31


def _folder(path: str, writer: int, batch: int) -> str:
    return f"{path.rstrip('/')}/writer={writer}/batch={batch}"


def write_batch(events: DataFrame, path: str, writer: int, batch: int) -> None:
    """One batch of events (kind, ts) of one writer; what an earlier attempt left is replaced."""
    if not 0 <= writer < WRITERS:
        raise ValueError(f"writers are numbered from 0 to {WRITERS - 1}")
    place = F.monotonically_increasing_id()
    rows = events.select("kind", F.col("ts").cast("timestamp").alias("ts"), F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit(2**33 - 1)).alias("row"))
    staged = f"{path.rstrip('/')}/_staged/{writer}-{batch}"  # names with _ are no data to Spark
    rows.write.mode("overwrite").parquet(staged)
    rows = events.sparkSession.read.schema(rows.schema).parquet(staged)
    before, total = {}, 0
    for part, n in sorted(tuple(r) for r in rows.groupBy("part").count().collect()):  # a row for each task of the batch
        before[part] = total
        total += n
    if total >= ROWS:
        raise ValueError(f"a batch of {total} rows; ids have room for {ROWS}")
    ahead = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("part")] if before else F.lit(0)
    id_ = ((F.lit(batch).cast("long") * ROWS + ahead + F.col("row")) * WRITERS + writer).alias("id")
    rows.select(id_, "kind", "ts").write.mode("overwrite").parquet(_folder(path, writer, batch))


def append_stream(events: DataFrame, path: str, checkpoint: str, writer: int = 0) -> StreamingQuery:
    """A stream of events (kind, ts) into the log; what has arrived is written and the query ends."""
    return events.writeStream.foreachBatch(lambda df, batch: write_batch(df, path, writer, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, ts) of all batches that were written whole."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    marks = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(hadoop, "writer=*/batch=*/_SUCCESS"))
    folders = [m.getPath().getParent().toString() for m in marks or []]
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
