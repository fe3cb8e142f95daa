"""Metric frames made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ALGORITHMS, RATIOS, SHAPES
from ..session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", "source", "metric", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"), F.col("segment").cast("long").alias("segment"))


def m_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value, a series for each event type."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return _frame(e.select(F.concat(F.lit("events/"), "event_type").alias("series_id"), F.lit("events").alias("source"), F.lit("value").alias("metric"), "ts", "value", F.lit(0).alias("segment")))


def m_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour: their number and mean value, a series for each event type."""
    e = table(spark, sf_dir, "events")
    h = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 9).alias("avg_value"))
    long = h.unpivot(["event_type", "ts"], ["n", "avg_value"], "metric", "value").where("value is not null")
    return _frame(long.select(F.concat(F.lit("events/"), "event_type").alias("series_id"), F.lit("events").alias("source"), "metric", "ts", "value", F.lit(0).alias("segment")))


def m_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals by day and priority, and items' quantities by day and flags."""
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("orders/"), "o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    i = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("items/"), "l_returnflag", "l_linestatus").alias("series_id"), F.col("l_shipdate").alias("ts")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    both = o.withColumn("metric", F.lit("total")).unionByName(i.withColumn("metric", F.lit("quantity")))
    return _frame(both.withColumn("source", F.lit("sales")).withColumn("segment", F.lit(0)))


def m_cumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series summed up from their start: they rise steadily."""
    w = Window.partitionBy("series_id", "metric").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m_day(spark, sf_dir).withColumn("value", F.round(F.sum("value").over(w), 2))


def sample_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all kinds, one for each order, over five hosts and nine metrics."""
    k = F.col("o_orderkey")
    host = F.concat(F.lit("host"), (F.col("o_custkey") % 5).cast("string"))
    kind = k % 9
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    series = (
        F.when(kind == 0, F.concat(F.lit("db_connection/"), host, F.lit(":7001/pool")))
        .when(kind.isin(1, 2, 6, 7), F.concat(F.lit("jvm_gc/app@"), host))
        .when(kind.isin(3, 4, 8), F.concat(F.lit("lsf_queue/"), host, F.lit("/long")))
        .otherwise(F.concat(F.lit("sar/"), host, F.lit("/cpu/-1")))
    )
    start = F.timestamp_add("MINUTE", (k * 37 % 1440).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select(
        series.alias("series_id"),
        pick(("db_connection", "jvm_gc", "jvm_gc", "lsf_queue", "lsf_queue", "sar", "jvm_gc", "jvm_gc", "lsf_queue"), kind).alias("source"),
        pick(("active_connections", "ou", "fgc_delta", "pend", "run", "pct_user", "eu", "mu", "susp"), kind).alias("metric"),
        pick(ALGORITHMS, F.floor(k / 7) % 11).alias("algorithm"),
        start.alias("start_ts"),
        F.timestamp_add("MINUTE", (k * 13 % 300).cast("int"), start).alias("end_ts"),
        F.array(F.col("o_totalprice").cast("double")).alias("values"),
        (0.5 + (k % 40) / 10.0).cast("double").alias("score"),
        pick(SHAPES, F.floor(k / 11) % 7).alias("shape"),
        F.create_map(F.lit("order"), k.cast("double")).alias("detail"),
    )


def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the same series, and shares of capacity for those that have one."""
    d = sample_detections(spark, sf_dir).withColumn("_k", F.element_at("detail", "order"))
    own = d.select("series_id", "source", "metric", F.col("start_ts").alias("ts"), F.element_at("values", 1).alias("value"), F.lit(0).alias("segment"))
    shares = d.where(F.col("metric").isin(*RATIOS)).select("series_id", "source", F.concat("metric", F.lit("_pct")).alias("metric"), F.col("start_ts").alias("ts"), (F.col("_k") % 120).alias("value"), F.lit(0).alias("segment"))
    return _frame(own.unionByName(shares))
