"""Stand-ins for spectra among the shared tables, each with its SQL.

A customer is a sample and its orders are peaks (observed: price / 100). For block counts, an order's line items count by return flag (A, N, R),
and the order status is the model. Suppliers of a nation are a second, larger kind of spectrum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_COMMON
from ..functions.exprs import common_mass

NAMES = ("Hex", "HexNAc", "dHex", "NeuAc")
MASSES = (162.052824, 203.079374, 146.05791, 291.095419)
LIMITS = (10, 8, 3, 4)
COMMON = common_mass(DEFAULT_COMMON, dict(zip(NAMES, MASSES)), 137.047679, "neg_h", "nr")
FLAGS = ("A", "N", "R")
#: Eight blocks with more compositions than a table of them may have.
NAMES8 = ("Hex", "HexNAc", "dHex", "NeuAc", "HexA", "dHexNAc", "Pent", "KDN")
MASSES8 = (162.052824, 203.079374, 146.05791, 291.095419, 176.03209, 187.084459, 132.04226, 250.06887)
LIMITS8 = (10, 4, 4, 4, 4, 4, 4, 4)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's peaks are dealt out and sorted together, so that nothing made from them for a sample needs another shuffle or sort. They are named before they are sorted,
    as Spark no longer takes them for sorted once the column they were sorted by is gone."""
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").repartition("o_custkey").select(F.col("o_custkey").alias("sample_id"), "o_orderkey", (F.col("o_totalprice") / 100).alias("observed"))
    return rows.select("sample_id", place.alias("peak_id"), "observed")


PEAKS_SQL = "peaks AS (SELECT o_custkey AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS peak_id, o_totalprice / 100 AS observed FROM orders)"


def nation_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sample_id"), place.alias("peak_id"), (F.lit(COMMON) + (F.col("s_acctbal") + 1000) / 4).alias("observed"))


NATION_SQL = f"peaks AS (SELECT s_nationkey AS sample_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS peak_id, {COMMON!r}::DOUBLE + (s_acctbal + 1000) / 4 AS observed FROM supplier)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, model, peak_id, observed, composition) of each order with line items."""
    counts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(*[F.count_if(F.col("l_returnflag") == f).cast("int") for f in FLAGS]).alias("composition"))
    orders = read(spark, sf_dir, "orders")
    return orders.join(counts, orders["o_orderkey"] == counts["l_orderkey"]).select(
        F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("peak_id"), (F.col("o_totalprice") / 100).alias("observed"), "composition"
    )


NODES_SQL = """nodes AS (SELECT o_custkey AS sample_id, o_orderstatus AS model, o_orderkey AS peak_id, o_totalprice / 100 AS observed, a, n, r FROM orders JOIN (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A')::INT AS a, count(*) FILTER (l_returnflag = 'N')::INT AS n, count(*) FILTER (l_returnflag = 'R')::INT AS r FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, observed, reconstructed): a line item's price and a line in its quantity, by return flag."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_extendedprice").alias("observed"), (F.col("l_quantity") * 1500.0 + 10.0).alias("reconstructed"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "ts")
