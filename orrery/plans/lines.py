"""The driver's tables as lines, patterns and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions.expressions import epoch
from orrery.operators import calibrate, derived
from orrery.plans.spec import Calibration, Dimension, Pattern

CUSTOMERS = Pattern(
    "customers",
    "c_custkey",
    (Dimension("order_count"), Dimension("order_sum"), Dimension("order_mean"), Dimension("order_max")),
)
SUPPLIERS = Pattern("suppliers", "s_suppkey", (Dimension("line_count"), Dimension("qty_sum"), Dimension("price_mean"), Dimension("part_count")))
SALES = Pattern(
    "sales",
    "o_orderkey",
    (Dimension("customer", "binary", "o_custkey", line="customers"), Dimension("price", "event", "o_totalprice"), Dimension("day", "event", "o_day")),
    pattern_type="event",
)

ORDER_METRICS = {"order_count": ("count", None), "order_sum": ("sum", "o_totalprice"), "order_mean": ("mean", "o_totalprice"), "order_max": ("max", "o_totalprice")}
LINE_METRICS = {"line_count": ("count", None), "qty_sum": ("sum", "l_quantity"), "price_mean": ("mean", "l_extendedprice"), "part_count": ("count_distinct", "l_partkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their order aggregates, kept for the passes of calibration."""
    return derived.derived_batch(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", ORDER_METRICS).persist()


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.derived_batch(table(spark, sf_dir, "supplier"), "s_suppkey", table(spark, sf_dir, "lineitem"), "l_suppkey", LINE_METRICS).persist()


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_day", F.dayofmonth("o_orderdate").cast("double"))


def customer_geometry(spark: SparkSession, sf_dir: str, pattern: Pattern = CUSTOMERS) -> tuple[DataFrame, Calibration]:
    rows = customers(spark, sf_dir)
    calibration = calibrate.calibrate(rows, pattern)
    return calibrate.geometry(rows, pattern, calibration), calibration


def supplier_geometry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Calibration]:
    rows = suppliers(spark, sf_dir)
    calibration = calibrate.calibrate(rows, SUPPLIERS)
    return calibrate.geometry(rows, SUPPLIERS, calibration), calibration


def sales_geometry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Calibration]:
    rows = sales(spark, sf_dir)
    calibration = calibrate.calibrate(rows, SALES)
    return calibrate.geometry(rows, SALES, calibration), calibration


def hand_overs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-to-supplier edges: consecutive lines of an order (from_key, to_key, event_key, timestamp, amount)."""
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    following = lines.withColumn("to_key", F.lead("l_suppkey").over(order))
    event = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return following.where("to_key is not null").select(
        F.col("l_suppkey").alias("from_key"), "to_key", event.alias("event_key"), epoch(F.col("l_shipdate")).alias("timestamp"), F.col("l_extendedprice").alias("amount")
    )
