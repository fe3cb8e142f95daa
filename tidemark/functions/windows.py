"""Window helpers over long metric frames: runs, gap merges, range frames, seasonal differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("series_id", "metric")
SECOND = 1_000_000
DAY, TOLERANCE = 24 * 3600 * SECOND, 150 * SECOND


def in_segment() -> WindowSpec:
    return Window.partitionBy(*SERIES, "segment").orderBy("us")


def in_series() -> WindowSpec:
    """A series' points in reading order: segment after segment."""
    return Window.partitionBy(*SERIES).orderBy("segment", "us")


def trailing(seconds: float, with_current: bool) -> WindowSpec:
    return in_segment().rangeBetween(-int(seconds * SECOND), 0 if with_current else -1)


def leading(seconds: float) -> WindowSpec:
    return in_segment().rangeBetween(0, int(seconds * SECOND))


def runs(starts: Column, over: WindowSpec) -> Column:
    """Number of the run that a row is in, where `starts` is true on each run's first row."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def seasonal_difference(points: DataFrame) -> DataFrame:
    """points with diff: the value less that of 24 hours before, null where there is none.

    The point before is the one nearest to 24 hours ago within the tolerance;
    of two that are equally near, the earlier.
    """
    w = in_segment()
    before, after = w.rangeBetween(-DAY - TOLERANCE, -DAY), w.rangeBetween(-DAY + 1, -DAY + TOLERANCE)
    point = F.struct("us", "value")
    near = points.withColumn("_b", F.max(point).over(before)).withColumn("_a", F.min(point).over(after))
    target = F.col("us") - DAY
    later = F.col("_b").isNull() | (F.col("_a.us") - target < target - F.col("_b.us"))
    picked = F.when(F.col("_a").isNotNull() & later, F.col("_a.value")).otherwise(F.col("_b.value"))
    return near.withColumn("diff", F.col("value") - picked).drop("_a", "_b")


def gap_clusters(df: DataFrame, keys: tuple[str, ...], gap: Column, order: tuple[str, ...], name: str = "cluster") -> DataFrame:
    """df with the number of the cluster of each interval [start_us, end_us] within its keys.

    An interval joins the cluster before it if it starts at most `gap`
    microseconds after the latest end so far.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    latest = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", latest.isNull() | (F.col("start_us") - latest > gap))
    return marked.withColumn(name, runs(F.col("_new"), w)).drop("_new")


def overlaps(a: DataFrame, b: DataFrame, on: tuple[str, ...], bucket_seconds: int, name: str = "_bucket") -> DataFrame:
    """Pairs of intervals of a (columns a_*) and b (columns b_*) that touch or overlap.

    A theta join would compare everything with everything. Each interval is
    laid into the time buckets that it covers, buckets are joined on equality,
    and a pair is taken from the bucket where the later of both starts, so once.
    """
    size = F.lit(bucket_seconds * SECOND)

    def laid(df: DataFrame, side: str) -> DataFrame:
        out = df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
        first, last = (F.floor(F.col(f"{side}_{c}") / size) for c in ("start_us", "end_us"))
        return out.withColumn(name, F.explode(F.sequence(first, last)))

    left, right = laid(a, "a"), laid(b, "b").withColumnRenamed(name, f"{name}2")
    same = F.col(name) == F.col(f"{name}2")
    for c in on:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    met = left.join(right, same).where((F.col("a_start_us") <= F.col("b_end_us")) & (F.col("b_start_us") <= F.col("a_end_us")))
    later = F.floor(F.greatest("a_start_us", "b_start_us") / size)
    out = met.where(F.col(name) == later).drop(name, f"{name}2")
    return out.withColumn("overlap_seconds", (F.least("a_end_us", "b_end_us") - F.greatest("a_start_us", "b_start_us")) / SECOND)


def inside(spans: DataFrame, points: DataFrame, on: tuple[str, ...], bucket_seconds: int = 24 * 3600) -> DataFrame:
    """Points (on, us, others) within spans (on, from_us, to_us, others), ends included.

    Equality on the series alone would compare each of its spans with each of
    its points. Spans are laid into the time buckets that they cover; a point is
    in one bucket, so it meets a span once.
    """
    size = F.lit(bucket_seconds * SECOND)
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from_us") / size), F.floor(F.col("to_us") / size))))
    p = points.withColumn("_bucket", F.floor(F.col("us") / size))
    return s.join(p, [*on, "_bucket"]).where(F.col("us").between(F.col("from_us"), F.col("to_us"))).drop("_bucket")
