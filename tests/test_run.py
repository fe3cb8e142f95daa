"""The whole run over generated logs, against the planted anomalies."""

from __future__ import annotations

import errno
import io
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import progress
from tidemark.__main__ import main, spark_settings
from tidemark.config import Config
from tidemark.errors import WriteError
from tidemark.operators import detectors, metrics
from tidemark.plans import report
from tidemark.plans.run import isolated, run
from tidemark.schema import METRICS
from tidemark.session import cut

from . import loggen


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    logs, out = tmp_path_factory.mktemp("logs"), tmp_path_factory.mktemp("out")
    loggen.generate(logs)
    config = Config()
    config.values["chart.max_per_host"] = 5
    analysis, written = run(spark, str(logs), config, str(out), datetime(2026, 6, 20))
    return analysis, written, out


def test_planted_anomalies_are_found(done):
    events = done[0].events.select("series_id", "metric", "algorithms", "severity", "source", "shape", "host").collect()
    for series, metric, some in loggen.PLANTED:
        mine = [e for e in events if (e.series_id, e.metric) == (series, metric)]
        assert any(some & set(e.algorithms) for e in mine), (series, metric, [e.algorithms for e in mine])
    leak = [e for e in events if (e.series_id, e.metric) == ("jvm_gc/app01@host01", "ou")]
    assert any(e.severity == "SEVERE" for e in leak)
    pend = [e for e in events if e.metric == "pend"]
    assert any(e.severity == "SEVERE" for e in pend)
    assert not done[0].failures


def test_clean_series_stay_quiet(done):
    clean = (F.col("series_id") == loggen.CLEAN[0]) & (F.col("metric") == loggen.CLEAN[1])
    found = done[0].detections.where(clean).collect()
    # Of white noise, 2-sigma points with another within two steps and 3-sigma points make up 1.04 %.
    for algorithm in {d.algorithm for d in found}:
        assert sum(d.detail.get("merged_points", 1) for d in found if d.algorithm == algorithm) < 0.014 * loggen.N
    assert all(e.severity != "SEVERE" for e in done[0].events.where(clean).collect())


def test_related_events_and_causes(done):
    events = done[0].events.collect()
    spike = loggen.START + timedelta(minutes=5 * 2000)
    pool = [e for e in events if e.series_id.endswith("Pool_1") and e.start_ts <= spike <= e.end_ts]
    assert any("pct_iowait" in [c.metric for c in e.co_anomalies or []] or "pct_iowait" in (e.concurrent or {}) for e in pool)
    rules = {e.event_id: [c.rule_id for c in e.causes] for e in events}
    assert any("CR-04" in rules[e.event_id] for e in events if e.metric == "pend")
    assert any("CR-05" in rules[e.event_id] for e in events if e.metric == "mu")
    points = [e for e in events if all(a.startswith("ALG-A") for a in e.algorithms)]
    assert all((e.co_anomalies is not None) == (e in points) for e in events)
    assert len(rules) == len(events)


def test_reports(done):
    analysis, written, out = done
    names = {p.rsplit("/", 1)[-1] for p in written}
    assert {"report_host01_202606.md", "report_host02_202606.md", "report_lsf01_202606.md", "report_summary_202606.md"} <= names
    summary = (out / "report_summary_202606.md").read_text()
    assert len(summary.encode()) < 8000 and "## 2. ホスト別の集計" in summary and "host01" in summary
    n = analysis.events.count()
    assert f"| 検知イベント数 | {n} (SEVERE: " in summary
    host = (out / "report_host01_202606.md").read_text()
    assert host.count("# イベントID(") == analysis.events.where("host = 'host01'").count()
    assert "* 原因候補 : " in host and "* 説明   : ALG-" in host and not list(out.glob("*.tmp"))
    charts = list((out / "charts").glob("EVT-*.svg"))
    assert charts and all("<polyline" in c.read_text() for c in charts)
    assert f"](charts/{charts[0].name})" in "".join(p.read_text() for p in out.glob("report_*.md"))


def test_reruns_agree(spark, done, tmp_path_factory):
    logs = tmp_path_factory.mktemp("again")
    loggen.generate(logs)
    config = Config()
    config.values["chart.enabled"] = False
    config.values["parameters.common.detect_threads"] = 1
    again, _ = run(spark, str(logs), config, str(tmp_path_factory.mktemp("out2")), datetime(2026, 6, 20))
    keys = ("event_id", "series_id", "metric", "start_ts", "end_ts", "severity", "shape")
    assert sorted(again.events.select(*keys).collect()) == sorted(done[0].events.select(*keys).collect())


def test_reports_are_printed_where_they_cannot_be_written(spark, done, tmp_path, capsys):
    logs = tmp_path / "logs"
    (logs).mkdir()
    rows = "".join(f"2026/06/01 {i // 60:02}:{i % 60:02}:00,h,1,p,{500 if i == 300 else 5}\n" for i in range(0, 600, 5))
    (logs / "DBConnection_20260601.csv").write_text("h\n" + rows)
    (tmp_path / "out").write_text("a file where the folder should be")
    with pytest.raises(WriteError):
        run(spark, str(logs), Config(), str(tmp_path / "out"), datetime(2026, 6, 20))
    printed = capsys.readouterr().out
    assert "# 異常検知サマリ 2026-06" in printed and "EVT-20260601-h-001" in printed
    quiet = tmp_path / "quiet"
    _, written = run(spark, _constant(tmp_path / "flat"), Config(), str(quiet), datetime(2026, 6, 20))
    assert [p.rsplit("/", 1)[-1] for p in written] == ["report_summary_202606.md"] and "検知された異常はありません。" in (quiet / "report_summary_202606.md").read_text()


def _constant(folder):
    folder.mkdir()
    (folder / "DBConnection_20260601.csv").write_text("h\n" + "".join(f"2026/06/01 {i // 60:02}:{i % 60:02}:00,h,1,p,5\n" for i in range(0, 600, 5)))
    return str(folder)


def test_progress_goes_to_two_streams():
    out, err = io.StringIO(), io.StringIO()
    progress.setup(out, err)
    progress.info("S3", "reading")
    progress.warning("S4", "odd")
    progress.setup()
    assert "[INFO] [S3] reading" in out.getvalue() and "odd" not in out.getvalue() and "[WARNING] [S4] odd" in err.getvalue()


def test_settings_for_the_session():
    c = Config()
    assert spark_settings(c)["spark.driver.memory"] == "4g"
    c.values["duckdb.max_memory"] = "1.5GB"
    assert spark_settings(c)["spark.driver.memory"] == "1536m"


def test_few_points_are_shown_as_a_table():
    event = {
        "event_id": "EVT-1", "series_id": "sar/h/cpu/-", "source": "sar", "metric": "pct_user", "algorithms": ["ALG-A3"], "start_ts": datetime(2026, 6, 1), "end_ts": datetime(2026, 6, 1), "values": [1.0], "shape": "spike_up",
        "severity": "FATAL", "detail": {"ALG-A3": '{"q1":1.0,"q3":2.0,"value":9.0}'}, "causes": [], "co_anomalies": [],
    }
    text = report.event_text(event, "UTC", "charts/no-chart.svg", [{"ts": datetime(2026, 6, 1), "value": 9.0}])
    assert "| 2026-06-01 00:00:00 (UTC) | 9 |" in text and "Q1=1, Q3=2, 値=9" in text and "該当する候補なし" in text


def test_exit_codes(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert main([]) == 1
    assert main([str(tmp_path / "nowhere")]) == 1
    (tmp_path / "s.properties").write_text("[parameters]\nALG-A1.k_warn = -1\n")
    assert main([str(tmp_path), "--settings", str(tmp_path / "s.properties")]) == 3
    (tmp_path / "logs").mkdir()
    assert main([str(tmp_path / "logs")]) == 2
    (tmp_path / "logs" / "DBConnection_20260601.csv").write_text("h\nx\n")
    assert main([str(tmp_path / "logs")]) == 4


@pytest.mark.parametrize(("error", "code"), [(OSError(errno.ENOSPC, "full"), 6), (RuntimeError("java.lang.OutOfMemoryError: Java heap space"), 6), (AnalysisException("x", {}), 6), (WriteError("x"), 5), (ValueError("x"), 99)])
def test_failures_of_storage_and_of_the_engine_have_a_code(tmp_path, monkeypatch, error, code):
    def fail(*args, **kwargs):
        raise error

    monkeypatch.setattr("tidemark.plans.run.run", fail)
    assert main([str(tmp_path)]) == code


def test_a_failure_loses_its_own_series_alone(spark, monkeypatch):
    rows = [(f"db_connection/h{k}:1/p", "db_connection", "active_connections", datetime(2026, 6, 1) + timedelta(minutes=5 * i), 500.0 if i % 300 == 299 else 10.0 + i % 7, 0) for k in range(11) for i in range(600)]
    points = cut(metrics.searchable(spark.createDataFrame(rows, METRICS)))
    series = cut(metrics.catalogue(points))
    whole = {(r.series_id, r.start_ts) for r in detectors.a1(points, series, Config())[0].collect()}
    assert len({s for s, _ in whole}) == 11

    def picky(points, series, config):
        bad = F.col("series_id").isin("db_connection/h3:1/p", "db_connection/h7:1/p")
        return detectors.a1(points.withColumn("value", F.when(bad, F.raise_error(F.lit("boom"))).otherwise(F.col("value"))), series, config)

    monkeypatch.setitem(detectors.DETECTORS, "ALG-A1", picky)
    parts, failures = isolated("ALG-A1", points, series, Config())
    got = {(r.series_id, r.start_ts) for f, _ in parts for r in f.collect()}
    assert got == {x for x in whole if x[0] not in ("db_connection/h3:1/p", "db_connection/h7:1/p")}
    assert sorted(f[:3] for f in failures) == [("ALG-A1", f"db_connection/h{k}:1/p", "active_connections") for k in (3, 7)]
    assert all("boom" in f[3] for f in failures)


def test_hosts_as_file_names(spark):
    events = spark.createDataFrame([("a/b",), ("a:b",), ("c",), ("a/b",), ("",)], "host string")
    assert {r.host: r["name"] for r in report.file_names(events).collect()} == {"a/b": "a_b", "a:b": "a_b-2", "c": "c", "": "unknown"}


def test_formats():
    assert [report.duration(s) for s in (60, 5400, 200000)] == ["1分", "1.5時間", "2.3日"]
    assert [report.overlap(s) for s in (0, 600, 7200)] == ["0 分", "10 分", "2.0 時間"]
    assert report.values_text([1.0] * 10) == "1→1→1→1→…→1→1→1→1" and report.values_text([]) == "(値なし)"
    assert report.series_text("sar", "sar/h/disk/sda") == "host=h, activity=disk, device=sda"
    assert report.series_text("db_connection", "db_connection/h:1/p/q") == "host=h, port=1, datasource=p/q"
