"""Events that overlap in time, and the causes that they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.windows import overlaps
from ..schema import CONFIDENCES
from .events import rank_of

MOST = 10
#: Seconds of a time bucket of the overlap joins: point events are short, others last for days.
POINT_BUCKET, ANY_BUCKET = 6 * 3600, 24 * 3600
UPWARD, RISING = ("spike_up", "trend_up", "floor_rise", "level_shift"), ("trend_up", "floor_rise")


def is_point(algorithms: Column) -> Column:
    """Only point detectors have found it; long trends would overlap with everything."""
    return (F.size(algorithms) > 0) & F.forall(algorithms, lambda a: a.startswith("ALG-A"))


def _spans(events: DataFrame) -> DataFrame:
    return events.select("event_id", "host", "source", "metric", "severity", "shape", "start_us", "end_us")


def _foremost(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first rows of each key, enough for MOST of other hosts, whichever host is asking."""
    of_host = F.row_number().over(Window.partitionBy(*keys, "b_host").orderBy(*order))
    of_key = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = rows.withColumn("_n", of_host).where(F.col("_n") <= MOST)
    return few.withColumn("_n", of_key).where(F.col("_n") <= 2 * MOST).drop("_n")


def _elsewhere(p: DataFrame, order: list[Column]) -> DataFrame:
    """For each event the foremost on other hosts that overlap.

    In an incident all hosts have events at once, and their pairs would be the
    square of the hosts. So pairs are made of the distinct spans of time alone;
    a span keeps its foremost events of each severity, and a span that asks
    keeps the foremost of all spans that it meets.
    """
    spans = p.select("start_us", "end_us").distinct()
    b = p.select(*(F.col(c).alias(f"b_{c}") for c in p.columns))
    few = _foremost(b, ("b_start_us", "b_end_us", "b_severity"), [F.asc("b_event_id")])
    met = overlaps(spans, spans, (), POINT_BUCKET).join(few, ["b_start_us", "b_end_us"])
    best = _foremost(met, ("a_start_us", "a_end_us"), order)
    a = p.select(F.col("event_id").alias("a_event_id"), F.col("host").alias("a_host"), F.col("start_us").alias("a_start_us"), F.col("end_us").alias("a_end_us"))
    return a.join(best, ["a_start_us", "a_end_us"]).where("a_host <> b_host")


def co_anomalies(events: DataFrame) -> DataFrame:
    """Rows (event_id, co_anomalies) of point events: the foremost that overlap, those of the host first, maybe none."""
    p = _spans(events.where(is_point(F.col("algorithms"))))
    order = [F.desc(rank_of(F.col("b_severity"))), F.desc("overlap_seconds"), F.asc("b_event_id")]
    mine = overlaps(p, p, ("host",), POINT_BUCKET).where("a_event_id <> b_event_id")
    names = ["a_event_id", *(f"b_{c}" for c in ("event_id", "host", "source", "metric", "severity", "shape")), "overlap_seconds"]
    pairs = mine.select(*names, F.lit(True).alias("same_host")).unionByName(_elsewhere(p, order).select(*names, F.lit(False).alias("same_host")))
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("a_event_id").orderBy(F.desc("same_host"), *order))).where(F.col("_n") <= MOST)
    other = F.struct(
        F.col("_n").alias("rank"), F.col("b_event_id").alias("event_id"), F.col("b_host").alias("host"), F.col("b_source").alias("source"), F.col("b_metric").alias("metric"),
        F.col("b_severity").alias("severity"), F.col("b_shape").alias("shape"), "overlap_seconds", "same_host",
    )
    lists = ranked.groupBy(F.col("a_event_id").alias("event_id")).agg(F.sort_array(F.collect_list(other)).alias("co_anomalies"))
    points = events.where(is_point(F.col("algorithms"))).select("event_id")
    empty = F.array().cast(lists.schema["co_anomalies"].dataType)
    return points.join(lists, "event_id", "left").withColumn("co_anomalies", F.coalesce("co_anomalies", empty))


def concurrent(events: DataFrame) -> DataFrame:
    """Rows (event_id, metric, other): for each other metric of the host the foremost event that overlaps."""
    s = _spans(events)
    pairs = overlaps(s, s, ("host",), ANY_BUCKET).where("a_event_id <> b_event_id AND a_metric <> b_metric")
    w = Window.partitionBy("a_event_id", "b_metric").orderBy(F.desc(rank_of(F.col("b_severity"))), "b_event_id")
    best = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select(F.col("a_event_id").alias("event_id"), F.col("b_metric").alias("metric"), F.struct(F.col("b_event_id").alias("event_id"), F.col("b_severity").alias("severity"), F.col("b_shape").alias("shape")).alias("other"))


def related(events: DataFrame) -> DataFrame:
    """events with co_anomalies (null, not empty, where trends take part) and concurrent, a map by metric."""
    by_metric = concurrent(events).groupBy("event_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "other")))).alias("concurrent"))
    return events.join(co_anomalies(events), "event_id", "left").join(by_metric, "event_id", "left")


def cross_host_groups(events: DataFrame) -> DataFrame:
    """Minutes in which point events of two hosts or more started together."""
    outside = F.filter("co_anomalies", lambda o: ~o["same_host"])
    e = events.where(F.size(outside) > 0).select(
        F.date_format("start_ts", "yyyy-MM-dd HH:mm").alias("started"), F.col("event_id"),
        F.concat(F.array("host"), F.transform(outside, lambda o: o["host"])).alias("hosts"), F.concat(F.array("metric"), F.transform(outside, lambda o: o["metric"])).alias("metrics"),
    )
    groups = e.groupBy("started").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hosts")))).alias("hosts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("metrics")))).alias("metrics"),
        F.count("*").alias("n_events"),
    )
    return groups.where(F.size("hosts") >= 2).orderBy(F.desc("n_events"), F.desc(F.size("hosts")), "started")


def cause_rules(config: Config) -> tuple[tuple[str, str, str, Column, str], ...]:
    """Rule, cause, confidence, condition and reason. Needs co_anomalies and concurrent."""
    metric, shape, source = F.col("metric"), F.col("shape"), F.col("source")
    other = lambda m: F.try_element_at("concurrent", F.lit(m))
    has = lambda c: F.coalesce(c, F.lit(False))
    increased = lambda m: has(other(m)["shape"].isin(*UPWARD))
    flat = lambda m: ~has(other(m)["shape"].isin(*RISING))
    rising = shape.isin(*RISING)
    high, medium, low = CONFIDENCES
    # The rules' names, confidences and wording are part of the results.
    return (
        ("CR-01", "メモリリーク", high, (metric == "ou") & (shape == "floor_rise") & increased("fgc_delta") & flat("eu"), "ou の下限が上がり続け、同時刻に fgc_delta の増加があり、eu のアノマリーが無いため"),
        ("CR-02", "負荷増に伴う正常な増加", medium, metric.isin("ou", "eu") & rising & (increased("active_connections") | increased("run")), "同時刻に負荷指標(active_connections または run)のアノマリーも出ているため"),
        ("CR-03", "コネクションリーク(クローズ漏れ)", high, (source == "db_connection") & (shape == "floor_rise"), "コネクション数の下限が上がり続け、回復していないため"),
        ("CR-04", "計算資源の枯渇、またはジョブのスタック", high, (metric == "pend") & rising & flat("run"), "待機ジョブが増え続ける一方、同時刻に run のアノマリーが無いため"),
        ("CR-05", "クラスローダリーク(動的クラス生成)", medium, (metric == "mu") & rising, "Metaspace の使用量が増え続けているため"),
        ("CR-06", "ヒープ不足による Full GC 頻発", high, metric.isin("fgct_delta", "fgc_delta") & has(other("ou_pct")["severity"] == "SEVERE"), f"Full GC が増える一方、同時刻に Old 世代使用率の SEVERE なアノマリーが出ているため(閾値 {float(config.param('events.severe_pct'))}%)"),
        ("CR-07", "一時的な負荷スパイク、または採取タイミングの揺れ", low, shape.isin("spike_up", "spike_down") & (F.coalesce(F.size("co_anomalies"), F.lit(0)) <= 0), "単発の逸脱であり、同時刻に他のアノマリーが検知されていないため"),
        ("CR-08", "設定変更・負荷段階の変化", medium, shape == "level_shift", "ある時刻を境に水準が移り、元に戻っていないため"),
        ("CR-09", "定期的な処理による周期的な負荷", low, shape == "seasonal_dev", "同じ曜日・時刻帯の平常値から外れているため"),
    )


def with_causes(events: DataFrame, config: Config) -> DataFrame:
    """events with causes: what the rules suggest, the surest first."""
    hits = [
        F.when(has, F.struct(F.lit(CONFIDENCES.index(sure)).alias("rank"), F.lit(rule).alias("rule_id"), F.lit(cause).alias("cause"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason")))
        for rule, cause, sure, has, reason in cause_rules(config)
    ]
    found = F.sort_array(F.array_compact(F.array(*hits)))
    return events.withColumn("causes", F.transform(found, lambda c: F.struct(*(c[k].alias(k) for k in ("rule_id", "cause", "confidence", "reason")))))
