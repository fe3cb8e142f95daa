"""What the physical plans must and must not have."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions.windows import SERIES, inside, overlaps
from tidemark.operators import detectors, metrics
from tidemark.plans import adapters, catalogue
from tidemark.session import cut, dealt

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalogue.QUERIES["scan_filter_project"](spark, SF))
    assert "LessThan(l_shipdate" in p.split("PushedFilters")[1] and "GreaterThanOrEqual(l_quantity" in p.split("PushedFilters")[1]
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert "l_comment" not in schema and "l_tax" not in schema
    assert "Exchange" not in p


def test_interval_joins_are_equi_joins(spark):
    spans = spark.range(1000).select(F.col("id").cast("string").alias("event_id"), (F.col("id") * 1000).alias("start_us"), (F.col("id") * 1000 + 5000).alias("end_us"))
    points = spark.range(1000).select(F.lit("s").alias("k"), (F.col("id") * 700).alias("us"))
    asked = spans.select(F.lit("s").alias("k"), F.col("start_us").alias("from_us"), F.col("end_us").alias("to_us"))
    for df in (overlaps(spans, spans, (), 3600), inside(asked, points, ("k",))):
        p = plan(df)
        assert "NestedLoop" not in p and "Cartesian" not in p
    got = inside(asked, points, ("k",), 1).count()
    assert got == sum(1 for i in range(1000) for j in range(1000) if i * 1000 <= j * 700 <= i * 1000 + 5000)


def test_a_detector_deals_its_points_by_series_only(spark):
    m = cut(adapters.m_hour(spark, SF))
    p = cut(metrics.searchable(m, None))
    s = cut(metrics.catalogue(p))
    for name in ("ALG-A1", "ALG-A5", "ALG-B1", "ALG-B3", "ALG-C1"):
        found, _ = detectors.DETECTORS[name](p, s, Config())
        keys = set(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(found)))
        plain = {re.sub(r"#\d+L?|, \d+$", "", k) for k in keys}
        assert "series_id, metric" in plain and not any(k.startswith("series_id, metric, segment") for k in plain), (name, plain)


def test_dealt_points_are_not_exchanged_again(spark):
    m = cut(adapters.m_hour(spark, SF))
    p = dealt(metrics.searchable(m, None), SERIES, "points")
    s = cut(metrics.catalogue(p))
    plain = cut(metrics.searchable(m, None))
    for name in ("ALG-A1", "ALG-A3", "ALG-B1", "ALG-B3", "ALG-B5"):
        found, _ = detectors.DETECTORS[name](p, s, Config())
        assert "Bucketed: true" in plan(found) and "Exchange hashpartitioning(series_id" not in plan(found), name
        rows = lambda df: sorted(tuple(r)[:6] for r in df.collect())
        assert rows(found) == rows(detectors.DETECTORS[name](plain, s, Config())[0])


def test_no_plan_of_a_query_compares_everything(spark):
    for name in ("overlap_topk", "overlap_same_host", "severity", "seasonal_diff", "a1_detections", "b3_floor", "top_metrics"):
        p = plan(catalogue.QUERIES[name](spark, SF))
        assert "Cartesian" not in p and "NestedLoop" not in p, name
