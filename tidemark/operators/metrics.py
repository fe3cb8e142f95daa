"""From the sources' base tables to the one long metric frame, and its catalogue of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros
from ..functions.windows import SECOND, SERIES, in_segment
from ..schema import DETECTABLE, KEYS


def first_wins(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ("file_date", "file_path", "line_no")) -> DataFrame:
    """The first row read of each key; null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def restart_segments(gc: DataFrame) -> DataFrame:
    """gc with segment, which grows by one at each restart of the JVM, and the deltas of its counters.

    A restart shows in an uptime below the one before, or without an uptime in
    a total GC time below the one before. Deltas are null across restarts and
    where a counter fell.
    """
    w = Window.partitionBy("container", "host").orderBy("ts")
    uptime, total = F.lag("jvm_uptime_sec").over(w), F.lag("gct").over(w)
    fell = (F.col("jvm_uptime_sec").isNotNull() & (F.col("jvm_uptime_sec") < uptime)) | (F.col("jvm_uptime_sec").isNull() & (F.col("gct") < total))
    # null, as without a row before, is no restart
    seg = F.sum(F.when(F.coalesce(fell, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = gc.withColumn("segment", seg.cast("long"))
    same = F.col("segment") == F.lag("segment").over(w)
    for c in ("fgc", "fgct", "ygct"):
        before = F.lag(c).over(w)
        out = out.withColumn(f"{c}_delta", F.when(same & (F.col(c) >= before), F.col(c) - before))
    return out


def _long(rows: DataFrame, series_id, source: str, values: dict, segment=None) -> DataFrame:
    """Rows of the metric frame from wide rows; null values are left out."""
    wide = rows.select(series_id.alias("series_id"), "ts", (segment if segment is not None else F.lit(0)).cast("long").alias("segment"), *(c.cast("double").alias(n) for n, c in values.items()))
    long = wide.unpivot(["series_id", "ts", "segment"], list(values), "metric", "value").where(F.col("value").isNotNull())
    return long.select("series_id", F.lit(source).alias("source"), "metric", "ts", "value", "segment")


def ratio_of(name: str):
    """The share of capacity in use: given as such, or used over capacity where that is positive."""
    return F.when(F.col("gc_format") == "gcutil", F.col(f"{name}u")).when(F.col(f"{name}c") > 0, F.col(f"{name}u") / F.col(f"{name}c") * 100.0)


def build(tables: dict[str, DataFrame]) -> DataFrame:
    """The metric frame of all sources that are there. A series id with a null part is null."""
    parts = []
    if (t := tables.get("db_connection")) is not None:
        key = F.concat(F.lit("db_connection/"), "host", F.lit(":"), F.col("port").cast("string"), F.lit("/"), "datasource")
        parts.append(_long(t, key, "db_connection", {"active_connections": F.col("active_connections")}))
    if (t := tables.get("jvm_gc")) is not None:
        t = restart_segments(t)
        key = F.concat(F.lit("jvm_gc/"), "container", F.lit("@"), "host")
        names = ("ou", "eu", "mu", "fgc_delta", "fgct_delta", "ygct_delta")
        parts.append(_long(t, key, "jvm_gc", {n: F.col(n) for n in names} | {f"{n}u_pct": ratio_of(n) for n in ("o", "e", "m")}, F.col("segment")))
    if (t := tables.get("lsf_queue")) is not None:
        key = F.concat(F.lit("lsf_queue/"), "host", F.lit("/"), "queue")
        parts.append(_long(t, key, "lsf_queue", {n: F.col(n) for n in ("njobs", "pend", "run", "susp")}))
    if (t := tables.get("sar")) is not None:
        key = F.concat(F.lit("sar/"), "host", F.lit("/"), "activity", F.lit("/"), "device")
        parts.append(t.where("value is not null").select(key.alias("series_id"), F.lit("sar").alias("source"), "metric", "ts", "value", F.lit(0).cast("long").alias("segment")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def searchable(metrics: DataFrame, names: tuple[str, ...] | None = DETECTABLE) -> DataFrame:
    """The metrics that detectors search, as points with us (microseconds). None: all."""
    chosen = metrics if names is None else metrics.where(F.col("metric").isin(*names))
    return chosen.where(F.col("series_id").isNotNull()).withColumn("us", micros("ts"))


def catalogue(points: DataFrame) -> DataFrame:
    """One row a series: points, span, and the median positive step within segments, 0 without one."""
    step = (F.col("us") - F.lag("us").over(in_segment())) / SECOND
    return (
        points.withColumn("_d", F.when(step > 0, step))
        .groupBy(*SERIES)
        .agg(
            F.min("source").alias("source"),
            F.count("*").alias("n_points"),
            F.min("ts").alias("t_min"),
            F.max("ts").alias("t_max"),
            F.coalesce(F.median("_d"), F.lit(0.0)).alias("interval_sec"),
        )
    )


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("series_id").alias("n_series"),
        F.countDistinct("metric").alias("n_metrics"),
        F.min("ts").alias("t_min"),
        F.max("ts").alias("t_max"),
    )


def dedupe_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: first_wins(rows, KEYS[name]) for name, rows in tables.items()}
