"""Names, types and the table of metrics that the whole engine shares."""

from __future__ import annotations

from dataclasses import dataclass

# Reasons, shapes, severities and confidences are part of the results.
REJECT_COLUMNS = "列数不一致"
REJECT_DATE = "日付書式不正"
REJECT_NUMBER = "数値変換不能"
REJECT_HEADER = "見出し不明"
SKIP_FEW_POINTS = "点数不足"
SKIP_WIDE = "分布が広く適用不可"
SKIP_NO_BASELINE = "基準期間の不足"
#: Shapes by priority when detections of one event differ.
SHAPES = ("floor_rise", "level_shift", "trend_up", "sustained", "seasonal_dev", "spike_up", "spike_down")
TREND_SHAPES = ("floor_rise", "trend_up", "level_shift")
SEVERITIES = ("INFO", "WARN", "FATAL", "SEVERE")
CONFIDENCES = ("高", "中", "低")
ALGORITHMS = ("ALG-A1", "ALG-A2", "ALG-A3", "ALG-A4", "ALG-A5", "ALG-B1", "ALG-B2", "ALG-B3", "ALG-B4", "ALG-B5", "ALG-C1")
SOURCES = ("db_connection", "jvm_gc", "lsf_queue", "sar")

#: Columns of the sources' base tables, and the keys by which the first row read wins.
TABLES = {
    "db_connection": "ts timestamp_ntz, host string, port int, datasource string, active_connections bigint",
    "jvm_gc": (
        "ts timestamp_ntz, container string, host string, jvm_uptime_sec double, gc_format string, s0c double, s1c double, s0u double, s1u double, "
        "ec double, eu double, oc double, ou double, mc double, mu double, ccsc double, ccsu double, ygc bigint, ygct double, fgc bigint, fgct double, gct double"
    ),
    "lsf_queue": "ts timestamp_ntz, host string, queue string, njobs bigint, pend bigint, run bigint, susp bigint",
    "sar": "ts timestamp_ntz, host string, activity string, device string, metric string, value double",
}
KEYS = {
    "db_connection": ("ts", "host", "port", "datasource"),
    "jvm_gc": ("ts", "container", "host"),
    "lsf_queue": ("ts", "host", "queue"),
    "sar": ("ts", "host", "activity", "device", "metric"),
}

METRICS = "series_id string, source string, metric string, ts timestamp_ntz, value double, segment bigint"
#: A detector's finding. Figures that explain it are in detail, by name.
DETECTIONS = (
    "series_id string, source string, metric string, algorithm string, start_ts timestamp_ntz, end_ts timestamp_ntz, "
    "values array<double>, score double, shape string, detail map<string,double>"
)
SKIPS = "series_id string, metric string, algorithm string, reason string"


@dataclass(frozen=True)
class Metric:
    """What the engine knows of a metric; a name that is not listed is carried but never searched."""

    source: str
    name: str
    #: The derived share of capacity that stands for it, if any.
    ratio: str | None = None
    #: No upper limit to stick to (saturation does not apply).
    unlimited: bool = False
    #: Itself a share from 0 to 100.
    percent: bool = False
    #: FATAL at most.
    never_severe: bool = False
    #: SEVERE when it reaches a new maximum at the end of the data.
    tail: bool = False


#: Metrics that sar reports, by activity.
SAR_ACTIVITIES = {
    "cpu": ("pct_user", "pct_system", "pct_iowait", "pct_idle"),
    "memory": ("pct_memused", "pct_commit", "kbmemfree"),
    "swap_space": ("pct_swpused",),
    "io": ("tps", "bread_s", "bwrtn_s"),
    "load": ("runq_sz", "ldavg_1", "ldavg_5", "blocked"),
    "swapping": ("pswpin_s", "pswpout_s"),
    "disk": ("pct_util", "await", "tps"),
    "network": ("pct_ifutil", "rxkb_s", "txkb_s"),
    "nfs": ("call_s", "retrans_s", "read_s", "write_s", "access_s", "getatt_s"),
    "nfsd": ("scall_s", "badcall_s", "hit_s", "miss_s", "sread_s", "swrite_s", "saccess_s", "sgetatt_s"),
}
_SAR_NAMES = sorted({m for names in SAR_ACTIVITIES.values() for m in names})

METRIC_TABLE: tuple[Metric, ...] = (
    Metric("db_connection", "active_connections", tail=True),
    *(Metric("jvm_gc", m, ratio=f"{m}_pct") for m in ("ou", "eu", "mu")),
    *(Metric("jvm_gc", m, unlimited=True, never_severe=True) for m in ("fgc_delta", "fgct_delta", "ygct_delta")),
    *(Metric("lsf_queue", m, unlimited=True, never_severe=True) for m in ("njobs", "run")),
    *(Metric("lsf_queue", m, tail=True) for m in ("pend", "susp")),
    *(Metric("sar", m, percent=m.startswith("pct_") and m != "pct_idle", unlimited=not m.startswith("pct_") or m == "pct_idle") for m in _SAR_NAMES),
)
DETECTABLE = tuple(dict.fromkeys(m.name for m in METRIC_TABLE))
RATIOS = {m.name: m.ratio for m in METRIC_TABLE if m.ratio}
