"""Merging, severities, overlaps, causes and settings."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import config as settings
from tidemark.config import Config
from tidemark.errors import ConfigError
from tidemark.functions.windows import overlaps
from tidemark.operators import co_anomaly, events, metrics, rollups
from tidemark.schema import DETECTIONS, METRICS, TABLES
from tidemark.session import cut

T0 = datetime(2026, 6, 1)
DB, GC, LSF = "db_connection/h1:1/p", "jvm_gc/app@h1", "lsf_queue/h2/q"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def det(series, metric, algorithm, start, end, score=1.5, shape="spike_up", values=(1.0,)):
    return (series, series.split("/")[0], metric, algorithm, at(start), at(end), [float(v) for v in values], float(score), shape, {"x": float(start)})


def merged(spark, rows):
    return events.merge(spark.createDataFrame(rows, DETECTIONS), Config())


def graded(spark, rows, points=()):
    m = spark.createDataFrame(list(points), METRICS)
    return {r.event_id: r for r in events.with_severity(cut(merged(spark, rows)), m, Config()).collect()}


def test_gap_is_inclusive_and_reaches_from_the_latest_end(spark):
    got = merged(spark, [
        det(DB, "active_connections", "ALG-A1", 0, 300), det(DB, "active_connections", "ALG-A2", 10, 20), det(DB, "active_connections", "ALG-A3", 360, 365),
        det(DB, "active_connections", "ALG-A1", 426, 430), det(GC, "ou", "ALG-A1", 0, 5),
    ]).orderBy("event_id").collect()
    assert [(r.event_id, r.algorithms, r.start_ts, r.end_ts) for r in got] == [
        ("EVT-20260601-h1-001", ["ALG-A1", "ALG-A2", "ALG-A3"], at(0), at(365)), ("EVT-20260601-h1-002", ["ALG-A1"], at(0), at(5)), ("EVT-20260601-h1-003", ["ALG-A1"], at(426), at(430)),
    ]


def test_fields_of_an_event(spark):
    got = merged(spark, [
        det(DB, "m", "ALG-B5", 0, 100, 1.2, "trend_up", (1, 2)), det(DB, "m", "ALG-A1", 0, 100, 3.0, "spike_up", (3,)), det(DB, "m", "ALG-A1", 50, 60, 1.0, "spike_down", (4,)), det(DB, "m", "ALG-B3", 20, 30, 1.1, "floor_rise", (5,)),
    ]).first()
    assert (got.score, got.shape, got.values) == (3.0, "floor_rise", [3.0])
    assert got.detail == {"ALG-A1": '{"x":0.0}', "ALG-B3": '{"x":20.0}', "ALG-B5": '{"x":0.0}'}


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(f"sar/h{i}/cpu/-1", "sar", "m", "ALG-A1", at(0), at(9), [float(v)], 1.0, "spike_up", {"order": float(k)}) for i in range(20) for k, v in ((9, 1), (10, 0), (8, 3), (8, 2))]
    for given in (rows, rows[::-1], sorted(rows, key=lambda r: r[6])):
        got = events.merge(spark.createDataFrame(given, DETECTIONS).coalesce(1), Config()).collect()
        assert len(got) == 20 and {(tuple(r["values"]), r.detail["ALG-A1"]) for r in got} == {((2.0,), '{"order":8.0}')}


def test_ids_beyond_a_thousand(spark):
    rows = [det(f"lsf_queue/h/q{i:04}", "run", "ALG-A1", 0, 1) for i in range(1001)]
    ids = [r.event_id for r in merged(spark, rows).orderBy("series_id").collect()]
    assert ids[0] == "EVT-20260601-h-001" and ids[-1] == "EVT-20260601-h-1001"
    assert merged(spark, [det("odd", "m", "ALG-A1", 0, 1)]).first().event_id == "EVT-20260601-unknown-001"


@pytest.mark.parametrize(("score", "n", "want"), [(0.5, 1, "INFO"), (1, 1, "WARN"), (2, 1, "FATAL"), (0.5, 3, "WARN"), (1, 3, "FATAL"), (2, 3, "SEVERE")])
def test_severity_by_score_and_agreement(spark, score, n, want):
    got = graded(spark, [det(DB, "m", f"ALG-A{i + 1}", 0, 1, score) for i in range(n)])
    assert [r.severity for r in got.values()] == [want]


def test_severe_conditions(spark):
    def points(series, metric, *values):
        return [(series, series.split("/")[0], metric, at(i * 10), float(v), 0) for i, v in enumerate(values)]

    trend = lambda series, metric: [det(series, metric, "ALG-B5", 0, 50, 1.0, "trend_up")]
    sev = lambda rows, pts: next(iter(graded(spark, rows, pts).values())).severity
    rising, back = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11), (1, 2, 11, 4, 5, 6, 7, 8, 9, 10, 11)
    assert sev(trend(LSF, "pend"), points(LSF, "pend", *rising)) == "SEVERE"
    assert sev(trend(LSF, "pend"), points(LSF, "pend", *back)) == "WARN"  # strictly above
    assert sev(trend(DB, "active_connections"), points(DB, "active_connections", *rising)) == "SEVERE"
    assert sev([det(LSF, "pend", "ALG-A1", 0, 50, 1.0)], points(LSF, "pend", *rising)) == "WARN"  # no trend
    assert sev(trend(LSF, "run"), points(LSF, "run", *rising)) == "WARN"
    assert sev(trend(GC, "ou"), points(GC, "ou_pct", 50, 91)) == "SEVERE"
    assert sev(trend(GC, "ou"), points(GC, "ou_pct", 50, 90)) == "WARN"
    assert sev(trend(GC, "ou"), []) == "WARN"
    capped = [det(GC, "fgc_delta", f"ALG-B{i}", 0, 50, 2.5, "trend_up") for i in (1, 2, 3)]
    assert sev(capped, []) == "FATAL"


def related(spark, rows, points=()):
    m = spark.createDataFrame(list(points), METRICS)
    e = cut(events.with_severity(cut(merged(spark, rows)), m, Config()))
    return {(r.series_id, r.metric, r.start_ts): r for r in co_anomaly.with_causes(cut(co_anomaly.related(e)), Config()).collect()}


def test_overlaps_touch_and_trends_have_none(spark):
    got = related(spark, [
        det(DB, "active_connections", "ALG-A1", 0, 10), det(LSF, "run", "ALG-A1", 10, 20), det(LSF, "pend", "ALG-B5", 0, 1000, 1, "trend_up"), det(GC, "ou", "ALG-C1", 0, 10, 1, "sustained"), det(GC, "mu", "ALG-A1", 500, 510),
    ])
    a = got[(DB, "active_connections", at(0))]
    assert [(c.metric, c.overlap_seconds, c.same_host) for c in a.co_anomalies] == [("run", 0.0, False)]
    assert got[(LSF, "pend", at(0))].co_anomalies is None and got[(GC, "ou", at(0))].co_anomalies is None
    assert got[(GC, "mu", at(500))].co_anomalies == []
    assert set(a.concurrent) == {"ou"} and set(got[(LSF, "run", at(10))].concurrent) == {"pend"}


def test_overlaps_over_many_buckets_count_once(spark):
    rows = [det(f"sar/h{i}/cpu/{j}", "pct_user", "ALG-A1", i * 50, i * 50 + 3000 * (i % 3 == 0) + 30) for i in range(30) for j in range(2)]
    e = cut(merged(spark, rows)).withColumn("severity", F.lit("WARN"))
    spans = e.select("event_id", "start_us", "end_us")
    met = overlaps(spans, spans, (), co_anomaly.POINT_BUCKET).where("a_event_id <> b_event_id")
    got = sorted((r.a_event_id, r.b_event_id, r.overlap_seconds) for r in met.collect())
    every = e.collect()
    want = sorted(
        (a.event_id, b.event_id, (min(a.end_us, b.end_us) - max(a.start_us, b.start_us)) / 1e6)
        for a in every for b in every if a.event_id != b.event_id and a.start_us <= b.end_us and b.start_us <= a.end_us
    )
    assert got == want
    top = co_anomaly.co_anomalies(e).collect()
    assert max(len(r.co_anomalies) for r in top) == 10


def spans_of(spark, rows):
    """Point events of (event_id, host, severity, start in minutes, end)."""
    return spark.createDataFrame(
        [(i, h, "sar", "m", s, "spike_up", int(a * 6e7), int(b * 6e7), ["ALG-A1"]) for i, h, s, a, b in rows],
        "event_id string, host string, source string, metric string, severity string, shape string, start_us long, end_us long, algorithms array<string>",
    )


def test_the_foremost_overlaps_match_brute_force(spark):
    rng = random.Random(3)
    rank = ["INFO", "WARN", "FATAL", "SEVERE"]
    rows = [(f"e{i:04}", f"h{rng.choice([0, 0, 0, *range(12)])}", rng.choice(["WARN", "SEVERE", "FATAL"]), a := 5 * rng.randrange(200), a + 5 * rng.randrange(6)) for i in range(500)]
    got = {r.event_id: [(o.event_id, o.host, o.severity, o.overlap_seconds, o.same_host) for o in r.co_anomalies] for r in co_anomaly.co_anomalies(spans_of(spark, rows)).collect()}
    for i, h, _, a, b in rows:
        met = [(j, k, s, (min(b, d) - max(a, c)) * 60.0, k == h) for j, k, s, c, d in rows if j != i and a <= d and c <= b]
        met.sort(key=lambda x: (not x[4], -rank.index(x[2]), -x[3], x[0]))
        assert got[i] == met[:10]


def test_a_storm_of_events_makes_no_pairs(spark):
    """All hosts at once: pairs would be 10^8."""
    rows = [(f"e{i:05}", f"h{i % 5000}", "WARN", 10 + i % 3, 12 + i % 3) for i in range(10_000)]
    e = spans_of(spark, rows)
    names = ["event_id", "host", "source", "metric", "severity", "shape", "start_us", "end_us"]
    assert co_anomaly._elsewhere(e.select(*names), [F.asc("b_event_id")]).count() <= 20 * len(rows)
    assert {len(r.co_anomalies) for r in co_anomaly.co_anomalies(e).collect()} == {10}


def test_causes(spark):
    rules = lambda r: [c.rule_id for c in r.causes]
    got = related(spark, [det(GC, "ou", "ALG-B3", 0, 100, 1, "floor_rise"), det(GC, "fgc_delta", "ALG-B4", 10, 20, 1, "level_shift")])
    assert rules(got[(GC, "ou", at(0))]) == ["CR-01"] and rules(got[(GC, "fgc_delta", at(10))]) == ["CR-08"]
    got = related(spark, [det(GC, "ou", "ALG-B3", 0, 100, 1, "floor_rise"), det(GC, "fgc_delta", "ALG-A1", 10, 20), det(GC, "eu", "ALG-B5", 10, 20, 1, "trend_up"), det(DB, "active_connections", "ALG-B3", 0, 50, 1, "floor_rise")])
    assert rules(got[(GC, "ou", at(0))]) == ["CR-02"] and rules(got[(DB, "active_connections", at(0))]) == ["CR-03"]
    got = related(spark, [det(LSF, "pend", "ALG-B5", 0, 100, 1, "trend_up"), det(GC, "mu", "ALG-B5", 0, 100, 1, "trend_up"), det("sar/x/cpu/-1", "pct_user", "ALG-A1", 5000, 5010), det("sar/y/cpu/-1", "pct_user", "ALG-A5", 9000, 9010, 1, "seasonal_dev")])
    assert rules(got[(LSF, "pend", at(0))]) == ["CR-04"] and rules(got[(GC, "mu", at(0))]) == ["CR-05"]
    assert rules(got[("sar/x/cpu/-1", "pct_user", at(5000))]) == ["CR-07"] and rules(got[("sar/y/cpu/-1", "pct_user", at(9000))]) == ["CR-09"]
    got = related(spark, [det(LSF, "pend", "ALG-B5", 0, 100, 1, "trend_up"), det(LSF, "run", "ALG-B5", 0, 100, 1, "trend_up")])
    assert rules(got[(LSF, "pend", at(0))]) == []


def test_metrics_of_all_sources(spark):
    gc = [
        (at(i * 5), "app", "h", float(u), fmt, None, None, None, None, None, 10.0, oc, 20.0, None, 30.0, None, None, y, float(y), f, float(f), g)
        for i, (u, fmt, oc, y, f, g) in enumerate([(10, "gc", 40.0, 5, 1, 1.0), (20, "gc", 0.0, 9, 1, 1.5), (5, "gcutil", None, 1, 0, 0.1), (15, "gcutil", None, 4, 2, 0.3)])
    ]
    tables = {
        "jvm_gc": spark.createDataFrame(gc, TABLES["jvm_gc"]),
        "db_connection": spark.createDataFrame([(at(0), "h", 1, "p", 5), (at(5), "h", None, "p", 6), (at(10), "h", 1, "p", None)], TABLES["db_connection"]),
        "lsf_queue": spark.createDataFrame([(at(0), "h", "q", 1, None, 2, 3)], TABLES["lsf_queue"]),
        "sar": spark.createDataFrame([(at(0), "h", "cpu", "-1", "pct_user", 7.0), (at(5), "h", "cpu", "-1", "pct_user", None)], TABLES["sar"]),
    }
    m = metrics.build(tables)
    got = {(r.series_id, r.metric, r.ts): (r.value, r.segment) for r in m.collect()}
    assert got[("db_connection/h:1/p", "active_connections", at(0))] == (5.0, 0) and got[(None, "active_connections", at(5))] == (6.0, 0)
    s = "jvm_gc/app@h"
    assert got[(s, "ou_pct", at(0))] == (50.0, 0) and (s, "ou_pct", at(5)) not in got and got[(s, "ou_pct", at(10))] == (20.0, 1)
    assert got[(s, "ygct_delta", at(5))] == (4.0, 0) and (s, "ygct_delta", at(10)) not in got and got[(s, "fgc_delta", at(15))] == (2.0, 1)
    assert {k[1] for k in got if k[0] == "lsf_queue/h/q"} == {"njobs", "run", "susp"} and got[("sar/h/cpu/-1", "pct_user", at(0))] == (7.0, 0)
    c = metrics.catalogue(metrics.searchable(m))
    assert {r.metric for r in c.where(F.col("series_id") == s).collect()} == {"ou", "eu", "mu", "fgc_delta", "fgct_delta", "ygct_delta"}
    assert c.where(F.col("series_id").isNull()).count() == 0


def test_thinning_locf_and_normalising(spark):
    p = spark.createDataFrame([("s", "m", i * 7, float(i)) for i in range(1000)], "series_id string, metric string, us long, value double")
    kept = [r.value for r in rollups.thinned(p, ("series_id",), 360).orderBy("us").collect()]
    assert len(kept) == 360 and kept[0] == 0 and kept[-1] == 999 and kept == [float(round(i * 999 / 359)) for i in range(360)]
    assert rollups.thinned(p.limit(10), ("series_id",), 360).count() == 10
    grid = spark.createDataFrame([("s", "m", x) for x in (-5, 0, 10, 7000)], "series_id string, metric string, us long")
    got = [r.value for r in rollups.locf(p, grid, ("series_id", "metric")).orderBy("us").collect()]
    assert got == [0.0, 0.0, 1.0, 999.0]
    assert [r.value for r in rollups.normalised(p.where("value < 3"), ("series_id",)).orderBy("us").collect()] == [0, 0.5, 1]


def test_chart_quota_has_two_parts(spark):
    rows = [det(f"sar/h/cpu/{i}", "pct_user", "ALG-A1", i // 2 * 1000, i // 2 * 1000 + 10, 2 + i / 100) for i in range(12)]
    e = cut(co_anomaly.related(cut(merged(spark, rows).withColumn("severity", F.lit("FATAL")))))
    config = Config(Config().values | {"chart.max_per_host": 3, "chart.max_overlay_per_host": 2})
    got = rollups.chart_choice(e, config).orderBy(F.desc("score")).collect()
    assert [round((r.score - 2) * 100) for r in got] == [11, 10, 9, 8, 7] and [r.overlay for r in got] == [False] * 3 + [True] * 2
    assert rollups.chart_choice(e.withColumn("severity", F.lit("WARN")), config).count() == 0


def test_settings(tmp_path):
    assert len(settings.SETTINGS) == 56 and settings.load(None).param("ALG-A1.k_warn") == 2.0
    path = tmp_path / "s.properties"
    path.write_text("﻿[parameters]\nALG-A1.k_warn = 2.5\nodd = 1\n[algorithms]\nALG-B4 = off\n[sar]\nactivities = cpu, DISK ,moon\n[other]\nx=1\n", encoding="utf-8")
    c = settings.load(path)
    assert c.param("ALG-A1.k_warn") == 2.5 and "ALG-B4" not in c.enabled() and c.activities() == ["cpu", "disk"] and len(c.warnings) == 3
    path.write_text("[parameters]\nALG-A1.k_warn = 5\nALG-A1.k_fatal = x\nALG-A4.lambda = 0\nALG-B2.p_fatal = 0.5\n[timezone]\nstorage = +09:00\n[duckdb]\nmax_memory = lots\n[chart]\nmin_severity = BAD\n")
    with pytest.raises(ConfigError) as e:
        settings.load(path)
    assert len(e.value.wrong) == 7 and e.value.exit_code == 3
