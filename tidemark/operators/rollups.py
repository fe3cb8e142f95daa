"""Roll-ups of events for reports and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.windows import SECOND, SERIES, inside
from ..schema import SEVERITIES
from .events import rank_of

LATEST_DAYS, TOP_ROWS, TOP_METRICS = 31, 10, 3
CHART_POINTS, CHART_LEAST, CHART_OVERLAYS = 360, 5, 5
PAD_LEAST, PAD_MOST = 30 * 60, 6 * 3600


def _counts():
    return [F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).cast("long").alias(f"n_{s.lower()}") for s in SEVERITIES]


def month(ts: str = "start_ts"):
    return F.date_format(ts, "yyyyMM")


def host_months(events: DataFrame) -> DataFrame:
    return events.groupBy("host", month().alias("ym")).agg(F.count("*").alias("n_events"), *_counts())


def host_digest(events: DataFrame) -> DataFrame:
    """Counts of each host, month and metric."""
    return events.groupBy("host", month().alias("ym"), "metric").agg(F.count("*").alias("n_events"), *_counts(), F.max("score").alias("max_score"))


def top_metrics(events: DataFrame, most: int = TOP_METRICS) -> DataFrame:
    """Hosts by severity, each with the metrics that have most events."""
    per = events.groupBy("host", "metric").agg(F.count("*").alias("n"))
    ranked = per.withColumn("_r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "metric"))).where(F.col("_r") <= most)
    names = ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "metric"))), lambda x: x["metric"]).alias("metrics"))
    hosts = events.groupBy("host").agg(F.count("*").alias("n_events"), *_counts())
    return hosts.join(names, "host").orderBy(F.desc("n_severe"), F.desc("n_fatal"), F.desc("n_events"), "host")


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("start_ts", "yyyy-MM-dd").alias("bucket")).agg(F.count("*").alias("n_events"), *_counts())


def weekly(events: DataFrame) -> DataFrame:
    """By ISO week; the first days of January may belong to the last week of the year before."""
    name = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "start_ts").cast("int"), F.weekofyear("start_ts").cast("int"))
    return events.groupBy(name.alias("bucket")).agg(F.count("*").alias("n_events"), *_counts())


def periods(events: DataFrame) -> DataFrame:
    """The busiest days, or weeks where there are many days, in time order."""
    days = events.select(F.to_date("start_ts")).distinct().count()
    table = weekly(events) if days > LATEST_DAYS else daily(events)
    return table.orderBy(F.desc("n_events"), "bucket").limit(TOP_ROWS).orderBy("bucket")


def skip_counts(skips: DataFrame) -> DataFrame:
    return skips.groupBy("algorithm", "reason").agg(F.count("*").alias("n"))


def chart_choice(events: DataFrame, config: Config) -> DataFrame:
    """Events that get a chart: per host the gravest, and apart from these the gravest that overlap with others."""
    least = SEVERITIES.index(str(config.get("chart.min_severity")).upper())
    e = events.where(rank_of(F.col("severity")) >= least)
    order = Window.partitionBy("host").orderBy(F.desc(rank_of(F.col("severity"))), F.desc("score"), "event_id")
    first = e.withColumn("_n", F.row_number().over(order)).withColumn("_first", F.col("_n") <= int(config.get("chart.max_per_host")))
    overlaid = F.coalesce(F.size("co_anomalies"), F.lit(0)) > 0
    again = Window.partitionBy("host", F.col("_first") | ~overlaid).orderBy(F.desc(rank_of(F.col("severity"))), F.desc("score"), "event_id")
    both = first.withColumn("_m", F.row_number().over(again))
    second = ~F.col("_first") & overlaid & (F.col("_m") <= int(config.get("chart.max_overlay_per_host")))
    return both.where(F.col("_first") | second).withColumn("overlay", ~F.col("_first")).drop("_n", "_m", "_first")


def chart_windows(events: DataFrame, config: Config) -> DataFrame:
    """events with from_us and to_us: the event and a margin of part of its length on either side."""
    length = (F.col("end_us") - F.col("start_us")) / SECOND
    pad = F.least(F.greatest(length * float(config.get("chart.pad_ratio")), F.lit(float(PAD_LEAST))), F.lit(float(PAD_MOST)))
    return events.withColumn("from_us", F.col("start_us") - (pad * SECOND).cast("long")).withColumn("to_us", F.col("end_us") + (pad * SECOND).cast("long"))


def thinned(points: DataFrame, keys: tuple[str, ...], most: int = CHART_POINTS) -> DataFrame:
    """At most `most` points of each group at even steps, both ends among them."""
    w = Window.partitionBy(*keys)
    at = points.withColumn("_i", F.row_number().over(w.orderBy("us")) - 1).withColumn("_c", F.count("*").over(w))
    step = (F.col("_c") - 1) / F.lit(float(most - 1))
    near = F.bround(F.bround(F.col("_i") / step, 0) * step, 0)
    return at.where((F.col("_c") <= most) | (near == F.col("_i"))).drop("_i", "_c")


def chart_points(chosen: DataFrame, points: DataFrame) -> DataFrame:
    """The thinned points of each chosen event's window."""
    met = inside(chosen.select("event_id", *SERIES, "from_us", "to_us"), points.select(*SERIES, "us", "ts", "value"), SERIES)
    return thinned(met.select("event_id", "us", "ts", "value"), ("event_id",))


def locf(points: DataFrame, grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The last value at or before each time of grid (keys, us); before the first, the first value."""
    both = points.select(*keys, "us", "value", F.lit(0).alias("_grid")).unionByName(grid.select(*keys, "us", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_grid")))
    w = Window.partitionBy(*keys).orderBy("us", "_grid")
    back = F.last_value("value", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min_by("value", F.when(F.col("_grid") == 0, F.col("us"))).over(Window.partitionBy(*keys))
    return both.withColumn("value", F.coalesce(back, first)).where("_grid = 1").drop("_grid")


def normalised(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Values from 0 to 1 within each group; 0 in groups of one value."""
    w = Window.partitionBy(*keys)
    low, high = F.min("value").over(w), F.max("value").over(w)
    return points.withColumn("value", F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.0))
