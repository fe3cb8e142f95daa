"""The registered queries of the engine's own operators, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars
from ..functions.windows import SERIES, seasonal_difference, trailing
from ..operators import co_anomaly, detectors, events, metrics, rollups
from ..schema import ALGORITHMS, SHAPES
from ..session import cut
from ..sources import files, parsers
from . import adapters, report
from .adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def text(c: Column | str) -> Column:
    return F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))


# --- frames in SQL ---------------------------------------------------------------------------

M_EVENT = "m AS (SELECT 'events/' || event_type AS series_id, 'value' AS metric, ts, value, 0 AS segment, epoch_us(ts) AS us FROM events WHERE value IS NOT NULL)"
_HOUR = """h AS (SELECT 'events/' || event_type AS series_id, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS n, round(avg(value), 9) AS avg_value FROM events GROUP BY ALL),
m AS (SELECT series_id, metric, ts::TIMESTAMP AS ts, value, 0 AS segment, epoch_us(ts::TIMESTAMP) AS us FROM (
  SELECT series_id, 'n' AS metric, ts, n AS value FROM h UNION ALL SELECT series_id, 'avg_value', ts, avg_value FROM h) WHERE value IS NOT NULL)"""
M_HOUR = _HOUR
M_DAY = """m AS (SELECT series_id, metric, ts, value, 0 AS segment, epoch_us(ts) AS us FROM (
  SELECT 'orders/' || o_orderpriority AS series_id, 'total' AS metric, o_orderdate::TIMESTAMP AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL
  UNION ALL SELECT 'items/' || l_returnflag || l_linestatus, 'quantity', l_shipdate::TIMESTAMP, round(sum(l_quantity), 2) FROM lineitem GROUP BY ALL))"""
CATALOGUE = """s AS (SELECT series_id, metric, count(*) AS n_points, min(ts) AS t_min, max(ts) AS t_max, coalesce(median(CASE WHEN d > 0 THEN d END), 0.0) AS interval_sec
  FROM (SELECT *, (us - lag(us) OVER (PARTITION BY series_id, metric, segment ORDER BY us)) / 1e6 AS d FROM m) GROUP BY series_id, metric)"""


def sigma(sd: str, level: str) -> str:
    return f"greatest(coalesce({sd}, 0), 0.02 * abs(coalesce({level}, 0)), 0.5, 1e-9)"


def graded(x: str, warn: str, fatal: str) -> str:
    return f"(CASE WHEN {x} < {warn} THEN 0 ELSE 1 + ({x} - ({warn})) / (({fatal}) - ({warn})) END)"


#: From hits (series_id, metric, us, ts, score, shape, interval_sec) to merged runs.
MERGED = """g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= greatest(2 * interval_sec, 1.0) * 1e6 THEN 0 ELSE 1 END AS brk FROM hits WINDOW w AS (PARTITION BY series_id, metric ORDER BY us)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY series_id, metric ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g),
kept AS (SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY series_id, metric, run) >= 2 OR round(score, 9) >= 2),
merged AS (SELECT series_id, metric, min(ts) AS start_ts, max(ts) AS end_ts, round(max(score), 6) AS score,
  CASE WHEN count(*) >= 3 THEN 'sustained' ELSE arg_min(shape, us) END AS shape, count(*) AS n_points FROM kept GROUP BY series_id, metric, run)"""
FOUND = "SELECT series_id, metric, start_ts, end_ts, score, shape, n_points FROM merged"


def found(detections: DataFrame) -> DataFrame:
    n = F.coalesce(F.try_element_at("detail", F.lit("merged_points")), F.lit(1.0)).cast("long")
    return detections.select(*SERIES, "start_ts", "end_ts", r6("score"), "shape", n.alias("n_points"))


def _frames(spark: SparkSession, sf_dir: str, adapter=adapters.m_hour) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = cut(adapter(spark, sf_dir))
    p = metrics.searchable(m, None)
    return m, p, metrics.catalogue(p)


CONFIG = Config()
#: The event stream has a point every 21 minutes or so: an hour would hold too few.
EVENTS_CONFIG = CONFIG.replaced(**{"ALG_A1__window_minutes": 180, "ALG_A2__window_minutes": 180})


# --- scans, projections, reshaping ------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, round(l_extendedprice * (1 - l_discount), 4) AS revenue
FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity >= 25""")
def scan_filter_project(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") >= 25))
    return items.select("l_orderkey", "l_linenumber", "l_returnflag", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query(f"""WITH {M_HOUR} SELECT series_id, metric, count(*) AS n, round(sum(value), 4) AS total FROM m WHERE metric IN ('n', 'other') GROUP BY ALL""")
def allowlist_semi_join(spark, sf_dir):
    names = spark.createDataFrame([("n",), ("other",)], "metric string")
    m = adapters.m_hour(spark, sf_dir).join(F.broadcast(names), "metric", "left_semi")  # a fixed list
    return m.groupBy(*SERIES).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {M_HOUR}, d AS (WITH {M_DAY} SELECT * FROM m), u AS (SELECT * FROM m UNION ALL SELECT * FROM d)
SELECT series_id, metric, count(*) AS n, min(ts) AS t_min, max(ts) AS t_max, round(sum(value), 3) AS total FROM u GROUP BY ALL""")
def union_all_long(spark, sf_dir):
    u = adapters.m_hour(spark, sf_dir).unionByName(adapters.m_day(spark, sf_dir))
    return u.groupBy(*SERIES).agg(F.count("*").alias("n"), F.min("ts").alias("t_min"), F.max("ts").alias("t_max"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH u AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, user_id, value, event_id AS seq FROM events),
x AS (SELECT *, row_number() OVER (PARTITION BY event_type, ts, user_id ORDER BY seq) AS rn FROM u)
SELECT event_type, ts, user_id, value, seq FROM x WHERE rn = 1""")
def dedupe_first_wins(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "user_id", "value", F.col("event_id").alias("seq"))
    return metrics.first_wins(u, ("event_type", "ts", "user_id"), ("seq",))


_GC = """gc AS (SELECT event_type AS container, 'h1' AS host, ts, CASE WHEN user_id % 3 = 0 THEN NULL ELSE (event_id % 50)::DOUBLE END AS jvm_uptime_sec,
  (event_id % 70)::DOUBLE AS gct, event_id % 90 AS fgc, (event_id % 40) / 2.0 AS fgct, value AS ygct FROM events),
lagged AS (SELECT *, lag(jvm_uptime_sec) OVER w AS pu, lag(gct) OVER w AS pg FROM gc WINDOW w AS (PARTITION BY container, host ORDER BY ts)),
seg AS (SELECT *, sum(CASE WHEN jvm_uptime_sec < pu OR (jvm_uptime_sec IS NULL AND gct < pg) THEN 1 ELSE 0 END) OVER (PARTITION BY container, host ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM lagged)"""


def _gc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("container"), F.lit("h1").alias("host"), "ts", F.when(F.col("user_id") % 3 != 0, (F.col("event_id") % 50).cast("double")).alias("jvm_uptime_sec"),
        (F.col("event_id") % 70).cast("double").alias("gct"), (F.col("event_id") % 90).alias("fgc"), ((F.col("event_id") % 40) / 2.0).alias("fgct"), F.col("value").alias("ygct"),
    )


@query(f"WITH {_GC} SELECT container, segment, count(*) AS n, min(ts) AS t_min, max(ts) AS t_max FROM seg GROUP BY ALL")
def restart_segment(spark, sf_dir):
    return metrics.restart_segments(_gc(spark, sf_dir)).groupBy("container", "segment").agg(F.count("*").alias("n"), F.min("ts").alias("t_min"), F.max("ts").alias("t_max"))


@query(f"""WITH {_GC} SELECT container, ts, segment,
CASE WHEN segment = lag(segment) OVER w AND fgc >= lag(fgc) OVER w THEN (fgc - lag(fgc) OVER w)::DOUBLE END AS fgc_delta,
CASE WHEN segment = lag(segment) OVER w AND fgct >= lag(fgct) OVER w THEN round(fgct - lag(fgct) OVER w, 6) END AS fgct_delta,
CASE WHEN segment = lag(segment) OVER w AND ygct >= lag(ygct) OVER w THEN round(ygct - lag(ygct) OVER w, 6) END AS ygct_delta
FROM seg WINDOW w AS (PARTITION BY container, host ORDER BY ts)""")
def segment_delta(spark, sf_dir):
    return metrics.restart_segments(_gc(spark, sf_dir)).select("container", "ts", "segment", F.col("fgc_delta").cast("double").alias("fgc_delta"), r6("fgct_delta"), r6("ygct_delta"))


_WIDE = """w AS (SELECT 'lsf_queue/' || n_name || '/' || c_mktsegment AS series_id, c_custkey AS k, n.n_nationkey AS a, c_acctbal AS b, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 9 END AS c
FROM customer JOIN nation n ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_WIDE} SELECT series_id, k, metric, round(value, 4) AS value FROM (
SELECT series_id, k, 'njobs' AS metric, a::DOUBLE AS value FROM w UNION ALL SELECT series_id, k, 'pend', b::DOUBLE FROM w UNION ALL SELECT series_id, k, 'run', c::DOUBLE FROM w) WHERE value IS NOT NULL""")
def unpivot_long(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    w = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("lsf_queue/"), "n_name", F.lit("/"), "c_mktsegment").alias("series_id"), F.col("c_custkey").alias("k"),
        F.col("n_nationkey").cast("double").alias("njobs"), F.col("c_acctbal").cast("double").alias("pend"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 9).cast("double").alias("run"),
    )
    return w.unpivot(["series_id", "k"], ["njobs", "pend", "run"], "metric", "value").where("value is not null").select("series_id", "k", "metric", F.round("value", 4).alias("value"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN o_custkey % 5 > 0 THEN o_totalprice / (o_custkey % 5) * 100.0 END, 4) AS ou_pct FROM orders""")
def ratio_derive(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "gcutil").otherwise("gc").alias("gc_format"), F.col("o_totalprice").alias("ou"), (F.col("o_custkey") % 5).alias("oc"))
    return o.select("o_orderkey", F.round(metrics.ratio_of("o"), 4).alias("ou_pct"))


@query(f"WITH {M_EVENT}, {CATALOGUE} SELECT series_id, metric, n_points, t_min, t_max, round(interval_sec, 6) AS interval_sec FROM s")
def series_catalog(spark, sf_dir):
    return metrics.catalogue(metrics.searchable(adapters.m_event(spark, sf_dir), None)).select(*SERIES, "n_points", "t_min", "t_max", r6("interval_sec"))


@query(f"WITH {M_HOUR} SELECT count(*) AS n_rows, count(DISTINCT series_id) AS n_series, count(DISTINCT metric) AS n_metrics, min(ts) AS t_min, max(ts) AS t_max FROM m")
def metrics_summary(spark, sf_dir):
    return metrics.summary(adapters.m_hour(spark, sf_dir))


@query("""SELECT event_id, (ts AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'America/New_York' AS local_ts FROM events""")
def tz_convert(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.in_zone(F.col("ts").cast("timestamp_ntz"), "Asia/Tokyo", "America/New_York").alias("local_ts"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '%' || p_name || '/s' WHEN 1 THEN p_name || '-' || p_partkey ELSE p_name || '%' END AS raw FROM part)
SELECT p_partkey, lower(replace(replace(regexp_replace(raw, '^%', 'pct_'), '/', '_'), '-', '_')) AS name FROM x""")
def col_name_normalize(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    raw = F.when(k % 3 == 0, F.concat(F.lit("%"), n, F.lit("/s"))).when(k % 3 == 1, F.concat(n, F.lit("-"), k.cast("string"))).otherwise(F.concat(n, F.lit("%")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.column_name(raw).alias("name"))


_IDS = """ids AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'db_connection/' || h || ':7001/p' WHEN 1 THEN 'jvm_gc/a@' || h WHEN 2 THEN 'lsf_queue/' || h || '/q'
WHEN 3 THEN 'sar/' || h || '/cpu/-1' WHEN 4 THEN 'db_connection/' || h || '/p' ELSE 'other/' || h END AS series_id FROM (SELECT s_suppkey, replace(s_name, '#', '.') AS h FROM supplier))"""


@query(f"""WITH {_IDS} SELECT s_suppkey, coalesce(nullif(regexp_extract(series_id, '^db_connection/([^/:]+):\\d+/.+$', 1), ''), nullif(regexp_extract(series_id, '^jvm_gc/[^@]+@(.+)$', 1), ''),
nullif(regexp_extract(series_id, '^lsf_queue/([^/]+)/.+$', 1), ''), nullif(regexp_extract(series_id, '^sar/([^/]+)/.+$', 1), ''), 'unknown') AS host FROM ids""")
def host_extract(spark, sf_dir):
    h, k = F.replace("s_name", F.lit("#"), F.lit(".")), F.col("s_suppkey") % 6
    put = lambda a, b: F.concat(F.lit(a), h, F.lit(b))
    ids = F.when(k == 0, put("db_connection/", ":7001/p")).when(k == 1, put("jvm_gc/a@", "")).when(k == 2, put("lsf_queue/", "/q")).when(k == 3, put("sar/", "/cpu/-1")).when(k == 4, put("db_connection/", "/p")).otherwise(put("other/", ""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.host_of(ids).alias("host"))


@query(f"""SELECT l_orderkey, l_linenumber, round({sigma("l_discount * 10", "l_extendedprice")}, 6) AS sigma, round({graded("l_quantity", "20", "40")}, 6) AS score FROM lineitem""")
def sigma_and_score(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", "l_linenumber", r6(scalars.effective_sigma(F.col("l_discount") * 10, F.col("l_extendedprice"), CONFIG), "sigma"), r6(scalars.graded(F.col("l_quantity"), 20, 40), "score"))


# --- sources: log lines made from the tables, in SQL parsed by plain functions ------------------

_NAMES = """f AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'DBConnection_2026' || lpad((c_custkey % 1000)::VARCHAR, 4, '0') || '.csv' WHEN 1 THEN 'bqueues_' || replace(c_name, '#', '_') || '_20260601.txt'
WHEN 2 THEN 'sa-' || replace(c_name, '#', '-') || '-20260602.csv' WHEN 3 THEN 'app_gc_x_gc_h' || c_custkey || '_20260603.txt' WHEN 4 THEN 'app_gc_h_2026.txt' WHEN 5 THEN 'notes.txt' ELSE 'DBConnection_1.csv' END AS name FROM customer)"""


@query(f"""WITH {_NAMES}, k AS (SELECT *, CASE WHEN regexp_full_match(name, 'DBConnection_\\d{{8}}\\.csv') THEN 'db_connection' WHEN regexp_full_match(name, 'bqueues_.+_\\d{{8}}\\.txt') THEN 'lsf_queue'
WHEN regexp_full_match(name, 'sa-.+-\\d{{8}}\\.csv') THEN 'sar' WHEN regexp_full_match(name, '.+_gc_.+_\\d{{8}}\\.txt') THEN 'jvm_gc' END AS kind FROM f)
SELECT c_custkey, kind, CASE WHEN kind IS NOT NULL THEN regexp_extract(name, '(\\d{{8}})\\.(csv|txt)$', 1) END AS file_date,
CASE kind WHEN 'lsf_queue' THEN regexp_extract(name, '^bqueues_(.+)_\\d{{8}}', 1) WHEN 'sar' THEN regexp_extract(name, '^sa-(.+)-\\d{{8}}', 1) WHEN 'jvm_gc' THEN regexp_extract(name, '^.+_gc_(.+)_\\d{{8}}', 1) END AS host,
CASE kind WHEN 'jvm_gc' THEN regexp_extract(name, '^(.+)_gc_.+_\\d{{8}}', 1) END AS container FROM k""")
def file_classify(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_name")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name = (
        F.when(k % 7 == 0, put("DBConnection_2026", F.lpad((k % 1000).cast("string"), 4, "0"), ".csv"))
        .when(k % 7 == 1, put("bqueues_", F.replace(n, F.lit("#"), F.lit("_")), "_20260601.txt"))
        .when(k % 7 == 2, put("sa-", F.replace(n, F.lit("#"), F.lit("-")), "-20260602.csv"))
        .when(k % 7 == 3, put("app_gc_x_gc_h", k.cast("string"), "_20260603.txt"))
        .when(k % 7 == 4, "app_gc_h_2026.txt").when(k % 7 == 5, "notes.txt").otherwise("DBConnection_1.csv")
    )
    return files.classified(table(spark, sf_dir, "customer").select("c_custkey", put("/logs/", name).alias("path"))).select("c_custkey", "kind", "file_date", "host", "container")


def _lines(rows: DataFrame, kind: str, fields: Column, line: Column | None = None) -> DataFrame:
    """Lines of one file for each host, headed by line 0, from rows with file_path, host and line_no."""
    return rows.select(
        "file_path", F.lit("20260601").alias("file_date"), F.lit(kind).alias("kind"), "host", F.lit("app").alias("container"), F.col("line_no").cast("long").alias("line_no"),
        fields.alias("fields"), (line if line is not None else F.lit("")).alias("line"),
    )


def _strings(*parts) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_DB_LINES = """l AS (SELECT event_id, 'DB' || (user_id % 4) AS file_path, CASE event_id % 13 WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y/%m/%d %H:%M:%S') END AS t, ' h' || user_id % 9 AS host,
  CASE event_id % 17 WHEN 2 THEN 'x' WHEN 3 THEN '70.9' ELSE '7001' END AS port, event_type AS pool, CASE event_id % 19 WHEN 4 THEN '-' WHEN 5 THEN 'nan' WHEN 6 THEN '' ELSE (event_id % 50)::VARCHAR END AS n, event_id % 23 = 7 AS short FROM events),
j AS (SELECT *, CASE WHEN short THEN '列数不一致' WHEN event_id % 13 = 1 THEN '日付書式不正' WHEN port = 'x' OR n = 'nan' THEN '数値変換不能' END AS reason FROM l)"""


def _db_lines(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("*", F.concat(F.lit("DB"), (F.col("user_id") % 4).cast("string")).alias("file_path"), F.lit(None).cast("string").alias("host"), (k + 1).alias("line_no"))
    t = F.when(k % 13 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    host = F.concat(F.lit(" h"), (F.col("user_id") % 9).cast("string"))
    port = F.when(k % 17 == 2, "x").when(k % 17 == 3, "70.9").otherwise("7001")
    n = F.when(k % 19 == 4, "-").when(k % 19 == 5, "nan").when(k % 19 == 6, "").otherwise((k % 50).cast("string"))
    whole = _strings(t, host, port, F.col("event_type"), n)
    return _lines(e, "db_connection", F.when(k % 23 == 7, F.slice(whole, 1, 3)).otherwise(whole))


@query(f"""WITH {_DB_LINES} SELECT file_path, event_id + 1 AS line_no, strptime(t, '%Y/%m/%d %H:%M:%S') AS ts, trim(host) AS host, floor(port::DOUBLE)::INTEGER AS port, pool AS datasource,
CASE WHEN n IN ('-', '') THEN NULL ELSE n::DOUBLE END AS active FROM j WHERE reason IS NULL""")
def parse_db_connection(spark, sf_dir):
    rows, _ = parsers.db_connection(_db_lines(spark, sf_dir))
    return rows.select("file_path", "line_no", "ts", "host", "port", "datasource", F.col("active_connections").cast("double").alias("active"))


@query(f"WITH {_DB_LINES} SELECT file_path, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL")
def reject_ledger(spark, sf_dir):
    _, rejects = parsers.db_connection(_db_lines(spark, sf_dir))
    return rejects.groupBy("file_path", "reason").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT *, 'Q' || (user_id % 3) AS file_path FROM events), g AS (SELECT *, CASE WHEN event_id % 11 = 3 OR event_id % 29 = 5 OR event_id % 31 = 6 THEN 1 ELSE 0 END AS bad FROM l)
SELECT file_path, event_id + 1 AS line_no, date_trunc('second', ts)::TIMESTAMP AS ts, q.queue, CASE q.queue WHEN 'long' THEN (event_id % 40)::DOUBLE END AS njobs, CASE q.queue WHEN 'long' THEN CASE WHEN event_id % 7 = 0 THEN NULL ELSE (user_id % 5)::DOUBLE END END AS pend,
CASE q.queue WHEN 'long' THEN NULL ELSE floor(value)::DOUBLE END AS run FROM g, (VALUES ('long'), ('a_b')) q(queue) WHERE bad = 0""")
def parse_lsf_queue(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("*", F.concat(F.lit("Q"), (F.col("user_id") % 3).cast("string")).alias("file_path"), F.lit("h").alias("host"))
    head = e.select("file_path", "host").distinct().withColumn("line_no", F.lit(0))
    stamp = F.when(k % 11 == 3, "soon").when(k % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(":07")))
    pend = F.when(k % 7 == 0, "-").otherwise((F.col("user_id") % 5).cast("string"))
    row = _strings(stamp, F.when(k % 29 == 5, "many").otherwise((k % 40).cast("string")), pend, F.floor("value"), "note")
    lines = _lines(head, "lsf_queue", _strings("time", "long_NJOBS", "long_PEND", "a_b_RUN", "note")).unionByName(
        _lines(e.withColumn("line_no", k + 1), "lsf_queue", F.when(k % 31 == 6, F.slice(row, 1, 4)).otherwise(row))
    )
    rows, _ = parsers.lsf_queue(lines)
    return rows.select("file_path", "line_no", "ts", "queue", *(F.col(c).cast("double").alias(c) for c in ("njobs", "pend", "run")))


@query("""WITH l AS (SELECT *, (['g12', 'g18', 'g17'])[user_id % 3 + 1] AS file_path, ([12, 18, 17])[user_id % 3 + 1] AS layout FROM events)
SELECT file_path, event_id + 1 AS line_no, date_trunc('second', ts)::TIMESTAMP AS ts, CASE layout WHEN 12 THEN 'gcutil' ELSE 'gc' END AS gc_format, round(value, 2) AS uptime,
(event_id % 100 + CASE layout WHEN 12 THEN 4 ELSE 8 END)::DOUBLE AS ou, CASE layout WHEN 12 THEN NULL ELSE (event_id % 100 + 7)::DOUBLE END AS oc, CASE layout WHEN 12 THEN (event_id % 100 + 6)::DOUBLE WHEN 18 THEN (event_id % 100 + 12)::DOUBLE END AS ccsu,
(event_id % 100 + CASE layout WHEN 12 THEN 7 WHEN 18 THEN 13 ELSE 12 END)::DOUBLE AS ygc, (event_id % 100 + layout - 1)::DOUBLE AS gct
FROM l WHERE event_id % 37 <> 1 AND event_id % 41 <> 2""")
def parse_jvm_gc(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("user_id") % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("*", pick("g12", "g18", "g17").alias("file_path"), pick(12, 18, 17).alias("layout"), F.lit("h").alias("host"))
    head = e.select("file_path", "host").distinct().withColumn("line_no", F.lit(0))
    # A first row of data that has the layout, whatever the others have.
    first = e.select("file_path", "host", "layout").distinct().withColumn("line_no", F.lit(0.5))
    numbers = F.transform(F.sequence(F.lit(1), F.col("layout") - 1), lambda i: (k % 100 + i).cast("string"))
    row = F.concat(_strings(F.date_format("ts", "yyyy/M/d"), F.date_format("ts", "H:m:s"), F.format_string("%.2f", "value")), numbers)
    row = F.when(k % 37 == 1, F.slice(row, 1, 9)).when(k % 41 == 2, F.concat(F.slice(row, 1, 4), _strings("x"), F.slice(row, 6, 99))).otherwise(row)
    lines = _lines(head, "jvm_gc", _strings("Timestamp", "S0")).unionByName(_lines(e.withColumn("line_no", k + 2), "jvm_gc", row))
    lines = lines.unionByName(_lines(first.withColumn("line_no", F.lit(1)), "jvm_gc", F.concat(_strings("none", "none"), F.transform(F.sequence(F.lit(1), F.col("layout")), lambda i: i.cast("string")))))
    rows, _ = parsers.jvm_gc(lines)
    return rows.select("file_path", (F.col("line_no") - 1).alias("line_no"), "ts", "gc_format", F.col("jvm_uptime_sec").alias("uptime"), "ou", "oc", "ccsu", F.col("ygc").cast("double").alias("ygc"), "gct")


@query("""WITH l AS (SELECT *, 'S' || (user_id % 3) AS file_path, (event_id // 10) % 3 AS block FROM events),
m AS (SELECT file_path, event_id, ts, CASE block WHEN 0 THEN 'cpu' ELSE 'load' END AS activity, CASE WHEN block = 0 AND event_id % 4 > 0 THEN (event_id % 4)::VARCHAR ELSE '-' END AS device, u.i, u.metric, u.v, CASE WHEN event_id % 9 = 4 THEN 2 ELSE 99 END AS bad
FROM l, (VALUES (0, 1, 'pct_user', 0), (0, 2, 'pct_system', 1), (0, 3, 'pct_iowait', 2), (0, 4, 'pct_idle', 3), (1, 1, 'runq_sz', 0), (1, 2, 'ldavg_1', 1), (1, 3, 'ldavg_5', 2)) u(b, i, metric, v) WHERE block = b AND event_id % 43 <> 3)
SELECT file_path, date_trunc('second', ts)::TIMESTAMP AS ts, activity, device, metric, (event_id % 60 + v)::DOUBLE AS value FROM m WHERE i < bad""")
def parse_sar(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("*", F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("file_path"), F.lit("h").alias("host"), (F.floor(k / 10) % 3).alias("block"))
    fixed = ("hostname", "interval", "timestamp")
    heads = [(0, (*fixed, "CPU", "%user", "%system", "%iowait", "%idle")), (1, (*fixed, "runq-sz", "ldavg-1", "ldavg-5")), (2, (*fixed, "strange"))]
    chosen = F.when(F.col("block") == 0, _strings(*heads[0][1])).when(F.col("block") == 1, _strings(*heads[1][1])).otherwise(_strings(*heads[2][1]))
    turns = e.groupBy("file_path", "host", "block", F.floor(k / 10).alias("g")).agg(F.min("event_id").alias("first"))
    head = _lines(turns.withColumn("line_no", 2 * F.col("first")), "sar", chosen, F.concat(F.lit("#"), F.array_join(chosen, ";")))
    number = lambda i: (k % 60 + i).cast("string")
    stamp = F.when(k % 43 == 3, "soon").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(k % 2 == 0, " UTC").otherwise("")))
    second = F.when(k % 9 == 4, "bad").otherwise(number(1))
    cpu = _strings("h", "300", stamp, F.when(k % 4 > 0, (k % 4).cast("string")).otherwise(" "), number(0), second, number(2), number(3))
    load = _strings("h", "300", stamp, number(0), second, number(2))
    row = F.when(F.col("block") == 0, cpu).otherwise(load)
    lines = head.unionByName(_lines(e.withColumn("line_no", 2 * k + 1), "sar", row, F.array_join(row, ";")))
    rows, _ = parsers.sar(lines)
    return rows.select("file_path", "ts", "activity", "device", "metric", "value")


@query("""SELECT event_id, CASE WHEN x IN ('', '-') THEN NULL WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN round(x::DOUBLE, 6) END AS number, x IN ('', '-') OR regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS fine,
CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trunc(x::DOUBLE) + 0.0 END AS whole
FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'nan' WHEN 3 THEN '1_000' WHEN 4 THEN '-' || printf('%.2f', value) WHEN 5 THEN '.5' WHEN 6 THEN '12e1' WHEN 7 THEN 'inf' ELSE printf('%.3f', value) END AS x FROM events)""")
def cast_helpers(spark, sf_dir):
    k, v = F.col("event_id") % 9, F.col("value")
    x = F.when(k == 0, "").when(k == 1, "-").when(k == 2, "nan").when(k == 3, "1_000").when(k == 4, F.concat(F.lit("-"), F.format_string("%.2f", v))).when(k == 5, ".5").when(k == 6, "12e1").when(k == 7, "inf").otherwise(F.format_string("%.3f", v))
    return table(spark, sf_dir, "events").select("event_id", r6(parsers.number(x), "number"), parsers.is_number(x).alias("fine"), parsers.whole(x).cast("double").alias("whole"))


# --- detectors --------------------------------------------------------------------------------

_A1 = f"""{M_EVENT}, {CATALOGUE},
l AS (SELECT m.*, interval_sec, avg(value) OVER w AS c, count(*) OVER w AS wn FROM m JOIN s USING (series_id, metric) WHERE n_points >= 30
  WINDOW w AS (PARTITION BY m.series_id, m.metric, segment ORDER BY us RANGE BETWEEN 10800000000 PRECEDING AND 1 PRECEDING)),
res AS (SELECT *, CASE WHEN wn >= 5 THEN value - c END AS r FROM l),
st AS (SELECT series_id, metric, avg(r) AS mu, stddev_pop(r) AS sd, count(r) AS rn, avg(value) AS level FROM res GROUP BY ALL)"""


@query(f"WITH {_A1} SELECT series_id, metric, rn AS n, round(mu, 6) AS mu, round(sd, 6) AS sd, round(level, 6) AS level FROM st")
def a1_residual_stats(spark, sf_dir):
    p = metrics.searchable(adapters.m_event(spark, sf_dir), None)
    w = trailing(180 * 60.0, with_current=False)
    r = p.withColumn("_c", F.avg("value").over(w)).withColumn("_n", F.count("value").over(w)).withColumn("_r", F.when(F.col("_n") >= 5, F.col("value") - F.col("_c")))
    return r.groupBy(*SERIES).agg(F.count("_r").alias("n"), r6(F.avg("_r"), "mu"), r6(F.stddev_pop("_r"), "sd"), r6(F.avg("value"), "level"))


@query(f"""WITH {_A1}, dv AS (SELECT res.*, mu, abs(r - mu) / {sigma("sd", "level")} AS dev FROM res JOIN st USING (series_id, metric) WHERE r IS NOT NULL AND rn >= 5),
hits AS (SELECT *, {graded("dev", "2", "3")} AS score, CASE WHEN r > mu THEN 'spike_up' ELSE 'spike_down' END AS shape FROM dv WHERE round(dev, 9) >= 2), {MERGED} {FOUND}""")
def a1_detections(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir, adapters.m_event)
    return found(detectors.a1(p, s, EVENTS_CONFIG)[0])


@query(f"""WITH {M_EVENT}, {CATALOGUE},
l AS (SELECT m.*, interval_sec, quantile_cont(value, 0.5) OVER w AS c, count(*) OVER w AS wn FROM m JOIN s USING (series_id, metric) WHERE n_points >= 30
  WINDOW w AS (PARTITION BY m.series_id, m.metric, segment ORDER BY us RANGE BETWEEN 10800000000 PRECEDING AND 1 PRECEDING)),
res AS (SELECT *, CASE WHEN wn >= 5 THEN value - c END AS r FROM l),
st AS (SELECT series_id, metric, median(r) AS mu, count(r) AS rn, median(value) AS level FROM res GROUP BY ALL),
st2 AS (SELECT series_id, metric, median(abs(r - mu)) AS mad FROM res JOIN st USING (series_id, metric) GROUP BY ALL),
dv AS (SELECT res.*, mu, abs(r - mu) / {sigma("1.4826 * mad", "level")} AS dev FROM res JOIN st USING (series_id, metric) JOIN st2 USING (series_id, metric) WHERE r IS NOT NULL AND rn >= 5),
hits AS (SELECT *, {graded("dev", "3", "4.5")} AS score, CASE WHEN r > mu THEN 'spike_up' ELSE 'spike_down' END AS shape FROM dv WHERE round(dev, 9) >= 3), {MERGED} {FOUND}""")
def a2_hampel(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir, adapters.m_event)
    return found(detectors.a2(p, s, EVENTS_CONFIG)[0])


@query(f"""WITH {M_HOUR}, {CATALOGUE},
q AS (SELECT series_id, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS med FROM m GROUP BY ALL),
b AS (SELECT *, {sigma("q3 - q1", "med")} AS iqr FROM q),
hits AS (SELECT m.*, n_points AS np, interval_sec, CASE WHEN value > q3 + 1.5 * iqr THEN {graded("value", "q3 + 1.5 * iqr", "q3 + 3 * iqr")} ELSE {graded("-value", "-(q1 - 1.5 * iqr)", "-(q1 - 3 * iqr)")} END AS score,
  CASE WHEN value > q3 + 1.5 * iqr THEN 'spike_up' ELSE 'spike_down' END AS shape FROM m JOIN s USING (series_id, metric) JOIN b USING (series_id, metric)
  WHERE n_points >= 30 AND (value > q3 + 1.5 * iqr OR value < q1 - 1.5 * iqr)),
{MERGED.replace("kept AS (SELECT * FROM r QUALIFY", "pre AS (SELECT * FROM r QUALIFY").replace("merged AS", "kept AS (SELECT * FROM pre QUALIFY count(*) OVER (PARTITION BY series_id, metric) <= np * 0.05), merged AS")} {FOUND}""")
def a3_tukey(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    return found(detectors.a3(p, s, CONFIG)[0])


_DIFF = """nb AS (SELECT m.*, max({'us': us, 'v': value}) OVER (w RANGE BETWEEN 86550000000 PRECEDING AND 86400000000 PRECEDING) AS b, min({'us': us, 'v': value}) OVER (w RANGE BETWEEN 86399999999 PRECEDING AND 86250000000 PRECEDING) AS a
  FROM m WINDOW w AS (PARTITION BY series_id, metric, segment ORDER BY us)),
d AS (SELECT * EXCLUDE (a, b), value - CASE WHEN a IS NOT NULL AND (b IS NULL OR a.us - (us - 86400000000) < (us - 86400000000) - b.us) THEN a.v ELSE b.v END AS diff FROM nb)"""


@query(f"WITH {M_HOUR}, {_DIFF} SELECT series_id, metric, ts, round(diff, 6) AS diff FROM d WHERE diff IS NOT NULL")
def seasonal_diff(spark, sf_dir):
    p = metrics.searchable(adapters.m_hour(spark, sf_dir), None)
    return seasonal_difference(p).where("diff is not null").select(*SERIES, "ts", r6("diff"))


@query(f"""WITH RECURSIVE {M_HOUR}, {CATALOGUE}, {_DIFF},
st AS (SELECT series_id, metric, avg(diff) AS mu, stddev_pop(diff) AS sd, count(diff) AS rn, avg(value) AS level FROM d GROUP BY ALL),
x AS (SELECT d.*, mu, {sigma("sd", "level")} AS sg, interval_sec, row_number() OVER (PARTITION BY d.series_id, d.metric ORDER BY us) AS rn2 FROM d JOIN st USING (series_id, metric) JOIN s USING (series_id, metric) WHERE diff IS NOT NULL AND rn >= 5 AND n_points >= 30),
z AS (SELECT series_id, metric, us, ts, interval_sec, mu, sg, rn2, 0.2 * diff + 0.8 * mu AS z FROM x WHERE rn2 = 1
  UNION ALL SELECT x.series_id, x.metric, x.us, x.ts, x.interval_sec, x.mu, x.sg, x.rn2, 0.2 * x.diff + 0.8 * z.z FROM z JOIN x ON x.series_id = z.series_id AND x.metric = z.metric AND x.rn2 = z.rn2 + 1),
dv AS (SELECT *, abs(z - mu) / (sg * sqrt(0.2 / 1.8 * (1 - pow(0.8, 2 * rn2)))) AS dev FROM z),
hits AS (SELECT *, {graded("dev", "3", "6")} AS score, CASE WHEN z > mu THEN 'spike_up' ELSE 'spike_down' END AS shape FROM dv WHERE dev > 3), {MERGED} {FOUND}""")
def a4_ewma(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    return found(detectors.a4(p, s, CONFIG)[0])


@query(f"""WITH {M_HOUR}, {CATALOGUE},
bk AS (SELECT series_id, metric, isodow(ts) AS dow, hour(ts) AS hr, avg(value) AS mu, coalesce(stddev_samp(value), 0) AS sd, count(*) AS nb, count(DISTINCT date_trunc('week', ts)) AS weeks FROM m GROUP BY ALL),
j AS (SELECT m.*, interval_sec, (nb * mu - value) / (nb - 1) AS ml, ((nb - 1) * sd * sd - nb / (nb - 1) * (value - mu) * (value - mu)) / (nb - 2) AS vl FROM m JOIN s USING (series_id, metric)
  JOIN bk ON bk.series_id = m.series_id AND bk.metric = m.metric AND dow = isodow(ts) AND hr = hour(ts) WHERE n_points >= 30 AND weeks >= 2 AND nb >= 3),
dv AS (SELECT *, abs(value - ml) / {sigma("sqrt(greatest(vl, 0))", "ml")} AS dev FROM j),
hits AS (SELECT *, {graded("dev", "3", "6")} AS score, 'seasonal_dev' AS shape FROM dv WHERE round(dev, 9) >= 3), {MERGED} {FOUND}""")
def a5_seasonal(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    return found(detectors.a5(p, s, CONFIG)[0])


#: Short and long windows, and the least run, for series with a few hundred points.
_B1_CONFIG = CONFIG.replaced(**{"ALG_B1__short_minutes": 360, "ALG_B1__long_minutes": 720, "ALG_B1__min_run": 4})


@query(f"""WITH {M_HOUR}, {CATALOGUE},
l AS (SELECT m.*, n_points, interval_sec, abs(value - lag(value) OVER o) AS step, avg(value) OVER (w RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS sh, avg(value) OVER (w RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS lo,
  us - min(us) OVER (PARTITION BY m.series_id, m.metric, segment) >= 43200000000 AS filled FROM m JOIN s USING (series_id, metric) WHERE n_points >= 30
  WINDOW w AS (PARTITION BY m.series_id, m.metric, segment ORDER BY us), o AS (PARTITION BY m.series_id, m.metric ORDER BY segment, us)),
st AS (SELECT series_id, metric, 0.25 * {sigma("median(step) * 1.4826 / sqrt(2)", "avg(value)")} AS margin, any_value(CASE WHEN interval_sec > 0 THEN greatest(4, floor(43200 / interval_sec)) ELSE 4 END)::BIGINT AS need FROM l GROUP BY ALL),
ab AS (SELECT l.*, margin, need, filled AND sh - lo > margin AS above FROM l JOIN st USING (series_id, metric)),
isl AS (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, metric, segment ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM ab)
SELECT series_id, metric, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length, round(count(*) / any_value(need), 6) AS score, round(arg_max(sh, us), 6) AS sma_short_end, round(any_value(margin), 6) AS margin
FROM isl WHERE above GROUP BY series_id, metric, segment, run HAVING count(*) >= any_value(need)""")
def b1_cross(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    d = detectors.b1(p, s, _B1_CONFIG)[0]
    of = lambda k: F.element_at("detail", F.lit(k))
    return d.select(*SERIES, "start_ts", "end_ts", of("run_length").cast("long").alias("length"), r6("score"), r6(of("sma_short_end"), "sma_short_end"), r6(of("margin"), "margin"))


#: Wide limits: every rising trend is reported, so that the figures are compared for many series.
_B2_CONFIG = CONFIG.replaced(**{"ALG_B2__bucket_minutes": 1440, "ALG_B2__p_warn": 0.99, "ALG_B2__p_fatal": 0.5, "ALG_B2__max_buckets": 400})


@query(f"""WITH {M_DAY}, {CATALOGUE},
f AS (SELECT m.*, (us - min(us) OVER (PARTITION BY m.series_id, m.metric)) // 86400000000 AS b0 FROM m JOIN s USING (series_id, metric) WHERE n_points >= 30),
ks AS (SELECT unnest(range(16)) AS k), c AS (SELECT series_id, metric, k, count(DISTINCT b0 // (1 << k)) AS nb FROM f, ks GROUP BY ALL),
w AS (SELECT series_id, metric, min(k) AS k FROM c WHERE nb <= 400 GROUP BY ALL),
b AS (SELECT series_id, metric, b0 // (1 << k) AS b, avg(value) AS v, any_value(k) AS k FROM f JOIN w USING (series_id, metric) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY series_id, metric ORDER BY b) AS i FROM b),
pr AS (SELECT x.series_id, x.metric, sum(sign(y.v - x.v))::DOUBLE AS s, median((y.v - x.v) / (y.i - x.i)) AS slope, any_value(x.k) AS k FROM o x JOIN o y ON x.series_id = y.series_id AND x.metric = y.metric AND x.i < y.i GROUP BY ALL),
t AS (SELECT series_id, metric, sum(n) AS n, sum(n * (n - 1) * (2 * n + 5)) AS tie FROM (SELECT series_id, metric, v, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
z AS (SELECT series_id, metric, n, s, slope * 1440 / (1440 * (1 << k)) AS slope, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tie) / 18.0) AS z FROM pr JOIN t USING (series_id, metric))
SELECT series_id, metric, s AS s_stat, round(z, 6) AS z_stat, n::BIGINT AS n_buckets, round(slope, 6) AS slope_per_day FROM z WHERE s > 0 AND abs(z) > 0.012533469508069276""")
def b2_mann_kendall(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir, adapters.m_day)
    d = detectors.b2(p, s, _B2_CONFIG)[0]
    of = lambda k: F.element_at("detail", F.lit(k))
    return d.select(*SERIES, of("S").alias("s_stat"), r6(of("Z"), "z_stat"), of("n_buckets").cast("long").alias("n_buckets"), r6(of("sen_slope_per_day"), "slope_per_day"))


_B3_CONFIG = CONFIG.replaced(**{"ALG_B3__window_minutes": 720, "ALG_B3__min_increases": 4})


@query(f"""WITH {M_HOUR}, {CATALOGUE},
f AS (SELECT m.*, (us - min(us) OVER (PARTITION BY m.series_id, m.metric, segment)) // 43200000000 AS b FROM m JOIN s USING (series_id, metric) WHERE n_points >= 30),
st AS (SELECT series_id, metric, {sigma("stddev_samp(value)", "avg(value)")} AS sg FROM f GROUP BY ALL),
bm AS (SELECT series_id, metric, segment, b, min(ts) AS ts, min(value) AS v FROM f GROUP BY ALL),
br AS (SELECT *, CASE WHEN b = lag(b) OVER w + 1 AND v >= lag(v) OVER w THEN 0 ELSE 1 END AS brk FROM bm WINDOW w AS (PARTITION BY series_id, metric, segment ORDER BY b)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY series_id, metric, segment ORDER BY b ROWS UNBOUNDED PRECEDING) AS run FROM br),
g AS (SELECT series_id, metric, segment, run, count(*) AS length, min(ts) AS start_ts, max(ts) AS end_ts, arg_max(v, b) - arg_min(v, b) AS rise FROM r GROUP BY ALL)
SELECT series_id, metric, start_ts, end_ts, length, round(rise, 6) AS rise, round(length / 4.0, 6) AS score FROM g JOIN st USING (series_id, metric) WHERE length >= 4 AND rise > sg""")
def b3_floor(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    d = detectors.b3(p, s, _B3_CONFIG)[0]
    of = lambda k: F.element_at("detail", F.lit(k))
    return d.select(*SERIES, "start_ts", "end_ts", of("run_length").cast("long").alias("length"), r6(of("total_rise"), "rise"), r6("score"))


@query(f"""WITH RECURSIVE {M_HOUR}, {CATALOGUE}, {_DIFF},
fd AS (SELECT *, min(CASE WHEN diff IS NOT NULL THEN us END) OVER (PARTITION BY series_id, metric) AS f0,
  avg(value) OVER (PARTITION BY series_id, metric ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS lb, avg(value) OVER (PARTITION BY series_id, metric ORDER BY us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS la FROM d),
st AS (SELECT series_id, metric, count(diff) AS n, avg(diff) AS m1, stddev_samp(diff) AS s1, count(diff) FILTER (us - f0 < 86400000000) AS n0, avg(diff) FILTER (us - f0 < 86400000000) AS m0, stddev_samp(diff) FILTER (us - f0 < 86400000000) AS s0, avg(value) AS level FROM fd GROUP BY ALL),
x AS (SELECT d.series_id, d.metric, us, diff, CASE WHEN n0 >= 30 THEN m0 ELSE m1 END AS mu, {sigma("CASE WHEN n0 >= 30 THEN s0 ELSE s1 END", "level")} AS sg, row_number() OVER (PARTITION BY d.series_id, d.metric ORDER BY us) AS rn
  FROM d JOIN st USING (series_id, metric) JOIN s USING (series_id, metric) WHERE diff IS NOT NULL AND n >= 30 AND n_points >= 30),
c AS (SELECT series_id, metric, rn, us, sg, greatest(0, diff - mu - 0.5 * sg) AS sp, CASE WHEN diff - mu - 0.5 * sg > 0 THEN us END AS st FROM x WHERE rn = 1
  UNION ALL SELECT x.series_id, x.metric, x.rn, x.us, x.sg, greatest(0, CASE WHEN c.sp > 5 * c.sg THEN 0 ELSE c.sp END + x.diff - x.mu - 0.5 * x.sg),
    CASE WHEN c.sp > 5 * c.sg OR c.sp <= 0 THEN CASE WHEN x.diff - x.mu - 0.5 * x.sg > 0 THEN x.us END ELSE c.st END
  FROM c JOIN x ON x.series_id = c.series_id AND x.metric = c.metric AND x.rn = c.rn + 1)
SELECT c.series_id, c.metric, make_timestamp(coalesce(c.st, c.us)) AS start_ts, make_timestamp(c.us) AS end_ts, round(sp, 6) AS s_plus, round(sp / (5 * sg), 6) AS score, round(b.lb, 6) AS level_before, round(a.la, 6) AS level_after
FROM c JOIN fd b ON b.series_id = c.series_id AND b.metric = c.metric AND b.us = coalesce(c.st, c.us) JOIN fd a ON a.series_id = c.series_id AND a.metric = c.metric AND a.us = c.us WHERE sp > 5 * sg""")
def b4_cusum(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    d = detectors.b4(p, s, CONFIG)[0]
    of = lambda k: r6(F.element_at("detail", F.lit(k)), k)
    return d.select(*SERIES, "start_ts", "end_ts", of("s_plus"), r6("score"), of("level_before"), of("level_after"))


@query(f"""WITH {M_DAY.replace("m AS", "m0 AS", 1)}, m AS (SELECT * REPLACE (round(sum(value) OVER (PARTITION BY series_id, metric ORDER BY us ROWS UNBOUNDED PRECEDING), 2) AS value) FROM m0), {CATALOGUE},
f AS (SELECT m.*, (us - min(us) OVER (PARTITION BY m.series_id, m.metric)) / 1e6 AS x FROM m JOIN s USING (series_id, metric) WHERE n_points >= 30),
g AS (SELECT series_id, metric, regr_slope(value, x) AS slope, regr_r2(value, x) AS r2, min(ts) AS start_ts, max(ts) AS end_ts, max(x) AS span, {sigma("stddev_samp(value)", "avg(value)")} AS sg FROM f GROUP BY ALL)
SELECT series_id, metric, start_ts, end_ts, round(slope * 86400, 4) AS slope_per_day, round(r2, 6) AS r2, round(least(r2 / 0.7, slope * span / sg), 6) AS score FROM g WHERE slope > 0 AND r2 >= 0.7 AND slope * span > sg""")
def b5_regression(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir, adapters.m_cumulated)
    d = detectors.b5(p, s, CONFIG)[0]
    of = lambda k: F.element_at("detail", F.lit(k))
    return d.select(*SERIES, "start_ts", "end_ts", F.round(of("slope_per_day"), 4).alias("slope_per_day"), r6(of("r2"), "r2"), r6("score"))


_C1_CONFIG = CONFIG.replaced(**{"ALG_C1__ratio_pct": 30.0, "ALG_C1__min_minutes": 120.0})


@query(f"""WITH {M_HOUR},
st AS (SELECT series_id, metric, count(*) AS n, max(value) AS top, count(DISTINCT value) AS dv, quantile_cont(value, 0.05) AS p5 FROM m GROUP BY ALL),
ok AS (SELECT *, top * 30.0 / 100 AS thr FROM st WHERE n >= 30 AND top > 0 AND dv >= 10 AND NOT (p5 > 0 AND top / p5 < 1.5)),
hh AS (SELECT m.*, top, thr, sum(CASE WHEN value >= thr THEN 0 ELSE 1 END) OVER (PARTITION BY m.series_id, m.metric, segment ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM m JOIN ok USING (series_id, metric))
SELECT series_id, metric, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n, round(avg(value), 6) AS avg_value, round(any_value(thr), 6) AS threshold, round((max(us) - min(us)) / 1e6 / 7200, 6) AS score
FROM hh WHERE value >= thr GROUP BY series_id, metric, segment, run HAVING (max(us) - min(us)) // 1000000 >= 7200""")
def c1_saturation(spark, sf_dir):
    _, p, s = _frames(spark, sf_dir)
    d = detectors.c1(p, s, _C1_CONFIG)[0]
    of = lambda k: F.element_at("detail", F.lit(k))
    return d.select(*SERIES, "start_ts", "end_ts", of("points").cast("long").alias("n"), r6(of("avg_value"), "avg_value"), r6(of("threshold"), "threshold"), r6("score"))


@query(f"""WITH {M_HOUR}, {CATALOGUE} SELECT algorithm, '点数不足' AS reason, count(*) AS n FROM s, (VALUES ('ALG-A1'), ('ALG-A2')) a(algorithm) GROUP BY ALL""")
def skip_counts(spark, sf_dir):
    """An hour's window holds too few hourly points, so that both detectors skip every series."""
    _, p, s = _frames(spark, sf_dir)
    return rollups.skip_counts(detectors.a1(p, s, CONFIG)[1].unionByName(detectors.a2(p, s, CONFIG)[1]))


# --- events -----------------------------------------------------------------------------------

_ALGORITHMS, _SHAPES = ("[" + ", ".join(f"'{x}'" for x in xs) + "]" for xs in (ALGORITHMS, SHAPES))
DETECTIONS = f"""o AS (SELECT *, 'host' || (o_custkey % 5) AS host, o_orderkey % 9 AS kind, o_orderdate::TIMESTAMP + to_minutes(((o_orderkey * 37) % 1440)::INTEGER) AS start_ts FROM orders),
det AS (SELECT CASE WHEN kind = 0 THEN 'db_connection/' || host || ':7001/pool' WHEN kind IN (1, 2, 6, 7) THEN 'jvm_gc/app@' || host WHEN kind IN (3, 4, 8) THEN 'lsf_queue/' || host || '/long' ELSE 'sar/' || host || '/cpu/-1' END AS series_id,
  (['db_connection', 'jvm_gc', 'jvm_gc', 'lsf_queue', 'lsf_queue', 'sar', 'jvm_gc', 'jvm_gc', 'lsf_queue'])[kind + 1] AS source, (['active_connections', 'ou', 'fgc_delta', 'pend', 'run', 'pct_user', 'eu', 'mu', 'susp'])[kind + 1] AS metric,
  ({_ALGORITHMS})[(o_orderkey // 7) % 11 + 1] AS algorithm, start_ts, start_ts + to_minutes(((o_orderkey * 13) % 300)::INTEGER) AS end_ts, o_totalprice AS price, 0.5 + (o_orderkey % 40) / 10.0 AS score, ({_SHAPES})[(o_orderkey // 11) % 7 + 1] AS shape, o_orderkey AS k, host FROM o)"""
EVENTS = f"""{DETECTIONS},
br AS (SELECT *, CASE WHEN start_ts <= max(end_ts) OVER (PARTITION BY series_id, metric ORDER BY start_ts, end_ts, algorithm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM det),
cl AS (SELECT *, sum(brk) OVER (PARTITION BY series_id, metric ORDER BY start_ts, end_ts, algorithm ROWS UNBOUNDED PRECEDING) AS cluster FROM br),
ev0 AS (SELECT series_id, metric, any_value(source) AS source, any_value(host) AS host, min(start_ts) AS start_ts, max(end_ts) AS end_ts, max(score) AS score, list_sort(list_distinct(list(algorithm))) AS algorithms,
  ({_SHAPES})[min(list_position({_SHAPES}, shape))] AS shape, arg_min(price, (-date_diff('second', start_ts, end_ts), algorithm, start_ts)) AS price FROM cl GROUP BY series_id, metric, cluster),
ev AS (SELECT *, 'EVT-' || strftime(start_ts, '%Y%m%d') || '-' || host || '-' || printf('%03d', row_number() OVER (PARTITION BY strftime(start_ts, '%Y%m%d'), host ORDER BY start_ts, series_id, metric)) AS event_id FROM ev0)"""


def _events(spark, sf_dir):
    return events.merge(adapters.sample_detections(spark, sf_dir), CONFIG)


@query(f"WITH {EVENTS} SELECT series_id, metric, source, start_ts, end_ts, round(score, 6) AS score, array_to_string(algorithms, '|') AS algorithms, shape, round(price, 4) AS first_value FROM ev")
def gap_merge_events(spark, sf_dir):
    return _events(spark, sf_dir).select(*SERIES, "source", "start_ts", "end_ts", r6("score"), text("algorithms").alias("algorithms"), "shape", F.round(F.element_at("values", 1), 4).alias("first_value"))


@query(f"WITH {EVENTS} SELECT event_id, host, series_id, metric, start_ts FROM ev")
def event_ids(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "host", *SERIES, "start_ts")


_HITS = """hits AS (SELECT event_id, 'events/' || event_type AS series_id, 'value' AS metric, ts, epoch_us(ts) AS us, 1 + value / 150 AS score, CASE WHEN event_id % 2 = 0 THEN 'spike_up' ELSE 'spike_down' END AS shape, 900.0 AS interval_sec FROM events)"""


def _hits(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.select(
        "event_id", F.concat(F.lit("events/"), "event_type").alias("series_id"), F.lit("value").alias("metric"), F.lit("events").alias("source"), "ts", scalars.micros("ts").alias("us"), (1 + F.col("value") / 150).alias("score"),
        F.when(F.col("event_id") % 2 == 0, "spike_up").otherwise("spike_down").alias("shape"), F.lit(900.0).alias("interval_sec"), F.array("value").alias("values"), F.create_map(F.lit("k"), F.col("event_id").cast("double")).alias("detail"),
    )


@query(f"WITH {_HITS}, {MERGED} SELECT event_id, series_id, ts, round(score, 6) AS score FROM kept")
def persistence_rule(spark, sf_dir):
    return detectors.persistent(_hits(spark, sf_dir)).select("event_id", "series_id", "ts", r6("score"))


@query(f"""WITH {_HITS.replace("event_id,", "event_id, value,", 1)}, {MERGED},
vs AS (SELECT *, lag(value) OVER (PARTITION BY series_id, run ORDER BY us) AS pv, row_number() OVER (PARTITION BY series_id, run ORDER BY us) AS rn FROM kept),
vl AS (SELECT series_id, run, min(ts) AS start_ts, string_agg(printf('%.2f', value), '|' ORDER BY us) FILTER (rn = 1 OR value <> pv) AS vals FROM vs GROUP BY ALL)
SELECT series_id, m.start_ts, end_ts, score, shape, n_points, vals AS joined FROM merged m JOIN vl USING (series_id, start_ts)""")
def merge_adjacent(spark, sf_dir):
    d = detectors.merged(detectors.persistent(_hits(spark, sf_dir)), ties=("event_id",))
    n = F.coalesce(F.try_element_at("detail", F.lit("merged_points")), F.lit(1.0)).cast("long")
    return d.select("series_id", "start_ts", "end_ts", r6("score"), "shape", n.alias("n_points"), F.concat_ws("|", F.transform("values", lambda v: F.format_string("%.2f", v))).alias("joined"))


@query(f"""WITH {M_DAY}, l AS (SELECT series_id, metric, list(value ORDER BY us) AS v, count(*) AS n FROM m GROUP BY ALL)
SELECT series_id, metric, array_to_string(list_transform(CASE WHEN n <= 9 THEN v ELSE list_transform(range(9), lambda i: v[round_even(i * ((n - 1) / 8.0), 0)::INTEGER + 1]) END, lambda x: printf('%.2f', x)), '|') AS sample FROM l""")
def sampled_values(spark, sf_dir):
    p = metrics.searchable(adapters.m_day(spark, sf_dir), None).groupBy(*SERIES).agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "value"))), lambda x: x["value"]).alias("_v"))
    return p.select(*SERIES, F.concat_ws("|", F.transform(scalars.sampled(F.col("_v")), lambda x: F.format_string("%.2f", x))).alias("sample"))


@query(f"WITH {DETECTIONS} SELECT series_id, metric, ({_SHAPES})[min(list_position({_SHAPES}, shape))] AS shape, count(*) AS n FROM det GROUP BY ALL")
def shape_priority(spark, sf_dir):
    rank = F.array_position(F.array(*map(F.lit, SHAPES)), F.col("shape"))
    return adapters.sample_detections(spark, sf_dir).groupBy(*SERIES).agg(F.min_by("shape", rank).alias("shape"), F.count("*").alias("n"))


SEVERITY = f"""{EVENTS},
pts AS (SELECT series_id, metric, start_ts AS ts, price AS value FROM det UNION ALL SELECT series_id, metric || '_pct', start_ts, (k % 120)::DOUBLE FROM det WHERE metric IN ('ou', 'eu', 'mu')),
rm AS (SELECT event_id, max(value) AS ratio_max FROM ev JOIN pts ON pts.series_id = ev.series_id AND pts.metric = ev.metric || '_pct' AND ev.metric IN ('ou', 'eu', 'mu') AND ts BETWEEN ev.start_ts AND ev.end_ts GROUP BY ALL),
bd AS (SELECT series_id, metric, epoch_us(max(ts)) - (epoch_us(max(ts)) - epoch_us(min(ts))) * 0.1 AS cut FROM pts GROUP BY ALL),
tl AS (SELECT series_id, metric, max(value) FILTER (epoch_us(ts) < cut) AS em, max(value) FILTER (epoch_us(ts) >= cut) AS tm FROM pts JOIN bd USING (series_id, metric) GROUP BY ALL),
sv0 AS (SELECT ev.*, CASE WHEN shape IN ('floor_rise', 'trend_up', 'level_shift') AND ((ev.metric IN ('ou', 'eu', 'mu') AND ratio_max > 90) OR (ev.metric IN ('active_connections', 'pend', 'susp') AND tm > em)) THEN 3 WHEN score >= 2 THEN 2 WHEN score >= 1 THEN 1 ELSE 0 END AS sev
  FROM ev LEFT JOIN rm USING (event_id) LEFT JOIN tl ON tl.series_id = ev.series_id AND tl.metric = ev.metric),
sv AS (SELECT * EXCLUDE (sev), (['INFO', 'WARN', 'FATAL', 'SEVERE'])[1 + CASE WHEN metric IN ('fgc_delta', 'run') THEN least(lifted, 2) ELSE lifted END] AS severity FROM (SELECT *, least(3, sev + CASE WHEN len(algorithms) >= 3 THEN 1 ELSE 0 END) AS lifted FROM sv0))"""


def _graded_events(spark, sf_dir):
    return cut(events.with_severity(cut(_events(spark, sf_dir)), adapters.sample_metrics(spark, sf_dir), CONFIG))


@query(f"WITH {SEVERITY} SELECT event_id, shape, round(score, 6) AS score, severity FROM sv")
def severity(spark, sf_dir):
    return _graded_events(spark, sf_dir).select("event_id", "shape", r6("score"), "severity")


_RANK = "list_position(['INFO', 'WARN', 'FATAL', 'SEVERE'], {})"
PAIRS = f"""{SEVERITY},
pt AS (SELECT * FROM sv WHERE len(list_filter(algorithms, lambda a: NOT starts_with(a, 'ALG-A'))) = 0),
pp AS (SELECT a.event_id, b.event_id AS other, a.host = b.host AS same_host, b.host AS other_host, b.metric AS other_metric, b.severity AS other_severity, (epoch_us(least(a.end_ts, b.end_ts)) - epoch_us(greatest(a.start_ts, b.start_ts))) / 1e6 AS overlap
  FROM pt a JOIN pt b ON a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts AND a.event_id <> b.event_id),
tp AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY same_host DESC, {_RANK.format("other_severity")} DESC, overlap DESC, other) AS rank FROM pp QUALIFY rank <= 10),
cc AS (SELECT a.event_id, b.metric, b.event_id AS other, b.severity AS other_severity, b.shape AS other_shape FROM sv a JOIN sv b ON a.host = b.host AND a.start_ts <= b.end_ts AND b.start_ts <= a.end_ts AND a.event_id <> b.event_id AND a.metric <> b.metric
  QUALIFY row_number() OVER (PARTITION BY a.event_id, b.metric ORDER BY {_RANK.format("b.severity")} DESC, b.event_id) = 1)"""


@query(f"WITH {PAIRS} SELECT event_id, metric, other, other_severity, other_shape FROM cc")
def overlap_same_host(spark, sf_dir):
    c = co_anomaly.concurrent(_graded_events(spark, sf_dir))
    return c.select("event_id", "metric", F.col("other.event_id").alias("other"), F.col("other.severity").alias("other_severity"), F.col("other.shape").alias("other_shape"))


@query(f"WITH {PAIRS} SELECT event_id, rank::INTEGER AS rank, other, same_host, round(overlap, 6) AS overlap FROM tp")
def overlap_topk(spark, sf_dir):
    c = co_anomaly.co_anomalies(_graded_events(spark, sf_dir)).select("event_id", F.explode("co_anomalies").alias("o"))
    return c.select("event_id", F.col("o.rank").alias("rank"), F.col("o.event_id").alias("other"), F.col("o.same_host").alias("same_host"), r6(F.col("o.overlap_seconds"), "overlap"))


@query(f"""WITH {PAIRS},
og AS (SELECT event_id, list(other_host) AS hs, list(other_metric) AS ms FROM tp WHERE NOT same_host GROUP BY ALL),
e AS (SELECT strftime(start_ts, '%Y-%m-%d %H:%M') AS started, list_concat([host], hs) AS hs, list_concat([metric], ms) AS ms FROM sv JOIN og USING (event_id))
SELECT started, array_to_string(list_sort(list_distinct(flatten(list(hs)))), '|') AS hosts, array_to_string(list_sort(list_distinct(flatten(list(ms)))), '|') AS metrics, count(*) AS n_events FROM e GROUP BY started HAVING len(list_distinct(flatten(list(hs)))) >= 2""")
def cross_host_groups(spark, sf_dir):
    g = co_anomaly.cross_host_groups(co_anomaly.related(_graded_events(spark, sf_dir)))
    return g.select("started", text("hosts").alias("hosts"), text("metrics").alias("metrics"), "n_events")


_UP, _RISING = "('spike_up', 'trend_up', 'floor_rise', 'level_shift')", "('trend_up', 'floor_rise')"


@query(f"""WITH {PAIRS},
n AS (SELECT event_id, count(*) AS n FROM tp GROUP BY ALL),
pv AS (SELECT event_id, max(other_shape) FILTER (metric = 'fgc_delta') AS fgc, max(other_shape) FILTER (metric = 'active_connections') AS act, max(other_shape) FILTER (metric = 'run') AS run, max(other_shape) FILTER (metric = 'eu') AS eu, max(other_severity) FILTER (metric = 'ou_pct') AS oup FROM cc GROUP BY ALL),
x AS (SELECT sv.*, coalesce(n, 0) AS n, fgc, act, run, eu, oup FROM sv LEFT JOIN n USING (event_id) LEFT JOIN pv USING (event_id)),
c AS (SELECT event_id, list_filter([CASE WHEN metric = 'ou' AND shape = 'floor_rise' AND fgc IN {_UP} AND coalesce(eu NOT IN {_RISING}, true) THEN 'CR-01' END, CASE WHEN source = 'db_connection' AND shape = 'floor_rise' THEN 'CR-03' END,
  CASE WHEN metric = 'pend' AND shape IN {_RISING} AND coalesce(run NOT IN {_RISING}, true) THEN 'CR-04' END, CASE WHEN metric IN ('fgct_delta', 'fgc_delta') AND oup = 'SEVERE' THEN 'CR-06' END,
  CASE WHEN metric IN ('ou', 'eu') AND shape IN {_RISING} AND (act IN {_UP} OR run IN {_UP}) THEN 'CR-02' END, CASE WHEN metric = 'mu' AND shape IN {_RISING} THEN 'CR-05' END, CASE WHEN shape = 'level_shift' THEN 'CR-08' END,
  CASE WHEN shape IN ('spike_up', 'spike_down') AND n = 0 THEN 'CR-07' END, CASE WHEN shape = 'seasonal_dev' THEN 'CR-09' END], lambda r: r IS NOT NULL) AS rules FROM x)
SELECT event_id, array_to_string(rules, '|') AS rules FROM c""")
def cause_rules(spark, sf_dir):
    e = co_anomaly.with_causes(co_anomaly.related(_graded_events(spark, sf_dir)), CONFIG)
    return e.select("event_id", text(F.transform("causes", lambda c: c["rule_id"])).alias("rules"))


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s.lower()}" for s in ("INFO", "WARN", "FATAL", "SEVERE"))


@query(f"WITH {SEVERITY} SELECT host, strftime(start_ts, '%Y%m') AS ym, count(*) AS n_events, {_COUNTS} FROM sv GROUP BY ALL")
def host_months(spark, sf_dir):
    return rollups.host_months(_graded_events(spark, sf_dir))


@query(f"WITH {SEVERITY} SELECT host, strftime(start_ts, '%Y%m') AS ym, metric, count(*) AS n_events, {_COUNTS}, round(max(score), 6) AS max_score FROM sv GROUP BY ALL")
def host_digest(spark, sf_dir):
    return rollups.host_digest(_graded_events(spark, sf_dir)).withColumn("max_score", F.round("max_score", 6))


@query(f"WITH {SEVERITY} SELECT strftime(start_ts, '%Y-%m-%d') AS bucket, count(*) AS n_events, {_COUNTS} FROM sv GROUP BY ALL")
def daily_rollup(spark, sf_dir):
    return rollups.daily(_graded_events(spark, sf_dir))


@query(f"WITH {SEVERITY} SELECT strftime(start_ts, '%G-W%V') AS bucket, count(*) AS n_events, {_COUNTS} FROM sv GROUP BY ALL")
def weekly_rollup(spark, sf_dir):
    return rollups.weekly(_graded_events(spark, sf_dir))


@query(f"""WITH {SEVERITY}, pm AS (SELECT host, metric, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, metric) AS r FROM sv GROUP BY host, metric QUALIFY r <= 3),
nm AS (SELECT host, string_agg(metric, '|' ORDER BY r) AS metrics FROM pm GROUP BY host) SELECT host, metrics, count(*) AS n_events, {_COUNTS} FROM sv JOIN nm USING (host) GROUP BY ALL""")
def top_metrics(spark, sf_dir):
    return rollups.top_metrics(_graded_events(spark, sf_dir)).withColumn("metrics", text("metrics"))


_QUOTA = Config(CONFIG.values | {"chart.max_per_host": 7, "chart.max_overlay_per_host": 5})
_CHART_ORDER = f"{_RANK.format('severity')} DESC, score DESC, event_id"


@query(f"""WITH {PAIRS}, ov AS (SELECT DISTINCT event_id FROM tp),
c AS (SELECT sv.*, ov.event_id IS NOT NULL AS has, row_number() OVER (PARTITION BY host ORDER BY {_CHART_ORDER.replace("event_id", "sv.event_id")}) AS n FROM sv LEFT JOIN ov USING (event_id) WHERE severity IN ('FATAL', 'SEVERE')),
d AS (SELECT *, row_number() OVER (PARTITION BY host, n <= 7 OR NOT has ORDER BY {_CHART_ORDER}) AS r FROM c)
SELECT event_id, host, n > 7 AS overlay FROM d WHERE n <= 7 OR (has AND r <= 5)""")
def chart_quota(spark, sf_dir):
    return rollups.chart_choice(co_anomaly.related(_graded_events(spark, sf_dir)), _QUOTA).select("event_id", "host", "overlay")


_NAMES = "CASE s_suppkey % 4 WHEN 0 THEN 'h/' || s_nationkey WHEN 1 THEN 'h:' || s_nationkey WHEN 2 THEN 'h?' || s_nationkey ELSE s_name END"


@query(f"""WITH h AS (SELECT DISTINCT {_NAMES} AS host FROM supplier), n AS (SELECT host, regexp_replace(host, '[\\\\/:*?"<>|]', '_', 'g') AS safe FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY host) AS n FROM n) SELECT host, CASE WHEN n = 1 THEN safe ELSE safe || '-' || n END AS name FROM r""")
def report_names(spark, sf_dir):
    return report.file_names(table(spark, sf_dir, "supplier").select(F.expr(_NAMES).alias("host")))


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, start_ts, end_ts, least(greatest(date_diff('second', start_ts, end_ts) * 0.25, 1800), 21600) AS pad FROM ev)
SELECT event_id, start_ts - to_microseconds((pad * 1000000)::BIGINT) AS from_ts, end_ts + to_microseconds((pad * 1000000)::BIGINT) AS to_ts FROM p""")
def chart_window(spark, sf_dir):
    w = rollups.chart_windows(_events(spark, sf_dir), CONFIG)
    at = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, timestamp_ntz'1970-01-01')")
    return w.select("event_id", at("from_us").alias("from_ts"), at("to_us").alias("to_ts"))


@query(f"""WITH {M_EVENT}, i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id, metric) AS c FROM m WINDOW w AS (PARTITION BY series_id, metric ORDER BY us))
SELECT series_id, metric, ts, value FROM i WHERE c <= 360 OR round_even(round_even(i / ((c - 1) / 359.0), 0) * ((c - 1) / 359.0), 0) = i""")
def thin_out(spark, sf_dir):
    return rollups.thinned(metrics.searchable(adapters.m_event(spark, sf_dir), None), SERIES).select(*SERIES, "ts", "value")


@query(f"""WITH {M_EVENT}, bd AS (SELECT series_id, metric, min(us) AS u0, min_by(value, us) AS v0 FROM m GROUP BY ALL), hrs AS (SELECT DISTINCT epoch_us(date_trunc('hour', ts)::TIMESTAMP) AS us FROM events),
g AS (SELECT series_id, metric, hrs.us FROM bd, hrs) SELECT g.series_id, g.metric, make_timestamp(g.us) AS ts, coalesce(m.value, v0) AS value FROM g ASOF LEFT JOIN m ON g.series_id = m.series_id AND g.metric = m.metric AND g.us >= m.us JOIN bd ON bd.series_id = g.series_id AND bd.metric = g.metric""")
def locf_align(spark, sf_dir):
    p = metrics.searchable(adapters.m_event(spark, sf_dir), None)
    hours = p.select(scalars.micros(F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("us")).distinct()
    grid = p.select(*SERIES).distinct().withColumn("_j", F.lit(1)).join(hours.withColumn("_j", F.lit(1)), "_j").select(*SERIES, "us")
    out = rollups.locf(p, grid, SERIES)
    return out.select(*SERIES, F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01')").alias("ts"), "value")


@query(f"""WITH {M_HOUR} SELECT series_id, metric, ts, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS value
FROM m WINDOW w AS (PARTITION BY series_id, metric)""")
def overlay_normalised(spark, sf_dir):
    return rollups.normalised(adapters.m_hour(spark, sf_dir), SERIES).select(*SERIES, "ts", r6("value"))


@query(f"""WITH {M_EVENT} SELECT series_id, metric, ts, array_to_string(list_transform(list(value) OVER (PARTITION BY series_id, metric ORDER BY us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda v: printf('%.2f', v)), '|') AS context FROM m""")
def value_context(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("us").rowsBetween(-2, 2)
    p = metrics.searchable(adapters.m_event(spark, sf_dir), None).withColumn("_c", F.collect_list("value").over(w))
    return p.select(*SERIES, "ts", F.concat_ws("|", F.transform("_c", lambda v: F.format_string("%.2f", v))).alias("context"))


@cache
def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
