"""Detections merged into events, with ids and severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import host_of, micros
from ..functions.windows import SECOND, SERIES, gap_clusters, inside
from ..schema import METRIC_TABLE, RATIOS, SEVERITIES, SHAPES, TREND_SHAPES

TAIL = 0.1


def rank_of(severity) -> F.Column:
    """0 for INFO up to 3 for SEVERE."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def merge(detections: DataFrame, config: Config) -> DataFrame:
    """One event for each cluster of a series' detections whose gaps are at most the merge gap.

    Of detections of one algorithm over the same span, the one with the least
    figures, then values, gives the event its own: never the order of the rows.
    """
    gap = int(float(config.param("events.merge_gap_minutes")) * 60 * SECOND)
    d = detections.withColumn("start_us", micros("start_ts")).withColumn("end_us", micros("end_ts"))
    d = gap_clusters(d, SERIES, F.lit(gap), ("start_us", "end_us", "algorithm"))
    keys = [*SERIES, "cluster"]
    least = (F.sort_array(F.map_entries("detail")), F.col("values"))
    order = F.struct("start_us", "end_us", *least)
    details = d.groupBy(*keys, "algorithm").agg(F.min_by("detail", order).alias("detail"))
    details = details.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("algorithm", F.to_json("detail"))))).alias("detail"))
    shape_rank = F.array_position(F.array(*map(F.lit, SHAPES)), F.col("shape"))
    longest = F.struct(F.col("start_us") - F.col("end_us"), "algorithm", "start_us", *least)
    merged = d.groupBy(*keys).agg(
        F.min("source").alias("source"),
        F.array_sort(F.collect_set("algorithm")).alias("algorithms"),
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.min_by("values", longest).alias("values"), F.max("score").alias("score"), F.min_by("shape", shape_rank).alias("shape"),
    )
    return with_ids(merged.join(details, keys).drop("cluster"))


def with_ids(events: DataFrame) -> DataFrame:
    """events with host and event_id: the day, the host, and a number within both."""
    e = events.withColumn("host", host_of(F.col("series_id"))).withColumn("_day", F.date_format("start_ts", "yyyyMMdd"))
    w = Window.partitionBy("_day", "host").orderBy("start_us", "series_id", "metric")
    number = F.row_number().over(w)
    return e.withColumn("event_id", F.concat_ws("-", F.lit("EVT"), "_day", "host", F.format_string("%03d", number))).drop("_day")


def promoted(severity, algorithms) -> F.Column:
    """One level up where three algorithms agree."""
    up = F.least(rank_of(severity) + 1 + F.when(F.size(algorithms) >= 3, 1).otherwise(0), F.lit(len(SEVERITIES)))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), up.cast("int"))


def series_tails(metrics: DataFrame) -> DataFrame:
    """Each series' highest value in the last tenth of its span, and before."""
    m = metrics.withColumn("us", micros("ts"))
    w = Window.partitionBy(*SERIES)
    cut = F.max("us").over(w) - (F.max("us").over(w) - F.min("us").over(w)) * TAIL
    m = m.withColumn("_tail", F.col("us") >= cut)
    return m.groupBy(*SERIES).agg(F.max(F.when(~F.col("_tail"), F.col("value"))).alias("earlier_max"), F.max(F.when(F.col("_tail"), F.col("value"))).alias("tail_max"))


def ratio_maxima(events: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per event of a metric with a share of capacity: the share's maximum within the event."""
    named = F.create_map(*(F.lit(x) for pair in RATIOS.items() for x in pair))[F.col("metric")]
    asked = events.where(F.col("metric").isin(*RATIOS)).select("event_id", "series_id", named.alias("metric"), F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us"))
    shares = metrics.where(F.col("metric").isin(*RATIOS.values())).select(*SERIES, micros("ts").alias("us"), "value")
    met = inside(asked, shares, SERIES)
    return met.groupBy("event_id").agg(F.max("value").alias("ratio_max"))


def with_severity(events: DataFrame, metrics: DataFrame, config: Config) -> DataFrame:
    """events with severity, by score, shape, what the metric's capacity says, and how many algorithms agree."""
    tails = {(m.source, m.name) for m in METRIC_TABLE if m.tail}
    never = {(m.source, m.name) for m in METRIC_TABLE if m.never_severe}
    of = lambda pairs: F.concat_ws("/", "source", "metric").isin(*sorted("/".join(p) for p in pairs))
    watched = metrics.where(F.col("metric").isin(*sorted({m for _, m in tails})))
    e = events.join(ratio_maxima(events, metrics), "event_id", "left").join(series_tails(watched), list(SERIES), "left")
    trend = F.col("shape").isin(*TREND_SHAPES)
    full = (F.col("source") == "jvm_gc") & F.col("metric").isin(*RATIOS) & (F.col("ratio_max") > float(config.param("events.severe_pct")))
    rising = of(tails) & (F.col("tail_max") > F.col("earlier_max"))
    base = F.when(trend & (F.coalesce(full, F.lit(False)) | F.coalesce(rising, F.lit(False))), "SEVERE").when(F.col("score") >= 2, "FATAL").when(F.col("score") >= 1, "WARN").otherwise("INFO")
    lifted = e.withColumn("severity", base).withColumn("severity", promoted(F.col("severity"), F.col("algorithms")))
    capped = F.when((F.col("severity") == "SEVERE") & of(never), "FATAL").otherwise(F.col("severity"))
    return lifted.withColumn("severity", capped).drop("ratio_max", "tail_max", "earlier_max")


def report_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc(rank_of(F.col("severity"))), "start_ts", "event_id")
