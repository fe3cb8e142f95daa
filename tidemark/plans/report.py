"""Events as Markdown: a report for each host and month, and a summary for each month.

Events are rendered where they are, one text a row. The driver takes one report
at a time and writes it through a temporary file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..errors import WriteError
from ..operators import rollups
from ..operators.co_anomaly import UPWARD, cross_host_groups
from ..operators.events import rank_of
from ..schema import SEVERITIES
from .wording import (
    ALGORITHM_NAMES, ASPECTS, EXPLANATIONS, MORE, MORE_CROSS, MORE_HOSTS, MORE_PERIODS, NO_CAUSE, NO_CROSS, NO_OTHERS, NO_POINTS, NONE_FOUND, NOTES, NOTHING, OTHER_HOST, PHENOMENA, SAME_HOST, UNKNOWN, WEEKDAYS,
)

HOST_ROWS, CROSS_ROWS, LISTED = 10, 8, 3
_UNSAFE = '\\/:*?"<>|'


def number(x: float | None) -> str:
    return UNKNOWN if x is None else f"{float(x):.4g}"


def values_text(values: list[float] | None) -> str:
    items = [number(v) for v in values or []]
    return "→".join(items if len(items) <= 9 else [*items[:4], "…", *items[-4:]]) or "(値なし)"


def duration(seconds: float, gap: str = "") -> str:
    for unit, most, text in ((60, 3600, "{0:.0f}{1}分"), (3600, 86400, "{0:.1f}{1}時間")):
        if seconds < most:
            return text.format(seconds / unit, gap)
    return f"{seconds / 86400:.1f}{gap}日"


def overlap(seconds: float) -> str:
    return "0 分" if seconds < 60 else duration(seconds, " ")


def stamp(ts: datetime | None, zone: str) -> str:
    return UNKNOWN if ts is None else f"{ts:%Y-%m-%d %H:%M:%S} ({zone})"


def series_text(source: str, series_id: str) -> str:
    parts = series_id.split("/", 1 if source in ("db_connection", "jvm_gc") else -1)
    if source == "db_connection" and len(parts) == 2:
        where, _, pool = parts[1].partition("/")
        host, _, port = where.partition(":")
        return f"host={host}, port={port}, datasource={pool}"
    if source == "jvm_gc" and "@" in series_id:
        container, _, host = parts[1].partition("@")
        return f"container={container}, host={host}"
    if source == "lsf_queue" and len(parts) >= 3:
        return f"host={parts[1]}, queue={parts[2]}"
    if source == "sar" and len(parts) >= 4:
        return f"host={parts[1]}, activity={parts[2]}" + (f", device={parts[3]}" if parts[3] != "-" else "")
    return series_id


def _figures(event: dict, algorithm: str) -> dict[str, float]:
    return json.loads((event["detail"] or {}).get(algorithm) or "{}")


def phenomenon(event: dict, zone: str) -> str:
    """What happened, by the event's shape."""
    shape = event["shape"]
    figures = {a: _figures(event, a) for a in event["algorithms"]}
    seconds = (event["end_ts"] - event["start_ts"]).total_seconds()
    words = {"duration": duration(seconds), "end": stamp(event["end_ts"], zone)}
    if shape in ("spike_up", "spike_down"):
        first = next((figures[a] for a in event["algorithms"] if a.startswith("ALG-A")), {})
        baseline = next((first[k] for k in ("mu", "median", "bucket_mu") if k in first), None)
        value = first.get("value")
        ratio = UNKNOWN if value is None or not baseline else number(value / baseline)
        words |= {"baseline": number(baseline), "value": number(value), "ratio": ratio}
    elif shape == "sustained" and figures.get("ALG-C1"):
        shape = "saturated"
        words |= {k: number(v) for k, v in figures["ALG-C1"].items()} | {"kind": "推定上限" if figures["ALG-C1"].get("ceiling_estimated") else "上限"}
    elif shape == "floor_rise":
        loaded = any(c["metric"] in ("active_connections", "run") and c["shape"] in UPWARD for c in event["co_anomalies"] or [])
        words["load"] = "負荷増を伴う" if loaded else "負荷増はない"
    elif shape == "trend_up":
        d = figures.get("ALG-B5") or figures.get("ALG-B2") or {}
        ends = event["values"] or [None]
        words |= {"first": number(ends[0]), "last": number(ends[-1]), "slope": number(d.get("slope_per_day", d.get("sen_slope_per_day")))}
    elif shape == "level_shift":
        d = figures.get("ALG-B4", {})
        words |= {k: number(d.get(k)) for k in ("level_before", "level_after")}
    elif shape == "seasonal_dev":
        d = figures.get("ALG-A5", {})
        words |= {k: number(d.get(k)) for k in ("bucket_mu", "value")}
        words["weekday"] = WEEKDAYS[int(d["dow"])] + "曜" if "dow" in d else UNKNOWN
        words["hour"] = f"{int(d['hour'])}時台" if "hour" in d else "不明な時刻帯"
    return PHENOMENA[shape].format(**words)


class _Unknown(dict):
    def __missing__(self, key: str) -> str:
        return UNKNOWN


def explanation(algorithm: str, d: dict[str, float]) -> str:
    """Why the algorithm has found it."""
    counts = ("run_length", "min_run", "window_minutes", "S", "points")
    words = _Unknown({k: str(int(v)) if k in counts else number(v) for k, v in d.items()})
    if "sigma_z" in d:
        words["limit"] = number(d["k"] * d["sigma_z"])
    if "held_seconds" in d:
        words["held"] = duration(d["held_seconds"], " ")
        words["kind"] = "推定上限" if d.get("ceiling_estimated") else "実際の上限"
    return EXPLANATIONS[algorithm].format_map(words)


def event_text(event: dict, zone: str = "UTC", chart: str | None = None, raw: list[dict] | None = None) -> str:
    names = ", ".join(f"{a} {ALGORITHM_NAMES[a]}" for a in event["algorithms"])
    pad = "\n             "
    causes = [f"{c['cause']} (確度: {c['confidence']}) — {c['reason']}" for c in event["causes"] or []]
    lines = [
        f"# イベントID( {event['event_id']} )", "",
        f"* イベント種別 : {names}",
        f"* 脅威度 : {event['severity']}",
        f"* データ : {event['source']} / {event['metric']} / {series_text(event['source'], event['series_id'])}",
        f"* 値     : {values_text(event['values'])}",
        f"* 開始   : {stamp(event['start_ts'], zone)}",
        f"* 終了   : {stamp(event['end_ts'], zone)}",
        f"* 現象   : {phenomenon(event, zone)}",
        f"* 説明   : {pad.join(f'{a}: {explanation(a, _figures(event, a))}' for a in event['algorithms'])}",
        f"* 原因候補 : {pad.join(causes) or NO_CAUSE}",
    ]
    if event["co_anomalies"] is not None:
        lines.append("* 同時に発生したアノマリー :")
        for c in event["co_anomalies"]:
            where = SAME_HOST if c["same_host"] else OTHER_HOST
            lines.append(f"  - {c['event_id']} ({where}) {c['source']} / {c['metric']} : {c['severity']} / 重なり {overlap(c['overlap_seconds'])}")
        if not event["co_anomalies"]:
            lines.append(NO_OTHERS)
    if chart:
        lines += ["", f"![{event['event_id']} {event['metric']} の推移]({chart})"]
    if raw is not None:  # too few points for a chart: the points themselves
        lines += ["", *table(("時刻", "値"), [(stamp(x["ts"], zone), number(x["value"])) for x in raw] or [(NO_POINTS, "—")])]
    return "\n".join(lines)


def rendered(events: DataFrame, zone: str = "UTC") -> DataFrame:
    """Rows (host, ym, place, text): each event's text, with its place in its report."""
    e = events
    for name, kind in (("chart", "string"), ("raw", "array<struct<ts:timestamp_ntz,value:double>>")):
        e = e if name in e.columns else e.withColumn(name, F.lit(None).cast(kind))
    columns = ["event_id", "series_id", "source", "metric", "algorithms", "start_ts", "end_ts", "values", "shape", "severity", "detail", "causes", "co_anomalies"]
    rows = e.select("host", rollups.month().alias("ym"), (-rank_of(F.col("severity"))).cast("int").alias("rank"), "start_us", F.struct(*columns).alias("event"), "chart", "raw")
    schema = "host string, ym string, rank int, start_us long, event_id string, text string"
    arrow = pa.schema([("host", pa.string()), ("ym", pa.string()), ("rank", pa.int32()), ("start_us", pa.int64()), ("event_id", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                event = r["event"]
                event["detail"] = dict(event["detail"] or {})
                out.append({k: r[k] for k in ("host", "ym", "rank", "start_us")} | {"event_id": event["event_id"], "text": event_text(event, zone, r["chart"], r["raw"])})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


# --- files ------------------------------------------------------------------------------------


def write_text(path: str | Path, text: str) -> str:
    """Write through a temporary file, so that no broken report is left."""
    half = f"{path}.tmp"
    try:
        with open(half, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(half, path)
    except OSError as e:
        raise WriteError(f"{path}: {e}") from e
    finally:
        if os.path.exists(half):
            os.unlink(half)
    return str(path)


def file_names(events: DataFrame) -> DataFrame:
    """Rows (host, name): hosts as parts of file names; those that become equal are numbered."""
    unsafe = "[" + re.escape(_UNSAFE) + "\\x00-\\x1f]"
    hosts = events.select("host").distinct()
    safe = F.coalesce(F.nullif(F.regexp_replace("host", unsafe, "_"), F.lit("")), F.lit("unknown"))
    number = F.row_number().over(Window.partitionBy("_safe").orderBy("host"))
    named = hosts.withColumn("_safe", safe).withColumn("_n", number)
    return named.select("host", F.when(F.col("_n") == 1, F.col("_safe")).otherwise(F.concat_ws("-", "_safe", "_n")).alias("name"))


def table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(map(str, r)) + " |" for r in (head, ("---",) * len(head), *rows)]


@dataclass
class Facts:
    """What a run knows besides its events."""

    now: datetime
    target: str
    period: tuple[datetime | None, datetime | None]
    files: int
    records: int
    series: int
    rejects: list[tuple]
    skips: list[tuple]
    failures: list[tuple]
    config: Config
    #: Rejects that are not listed.
    more_rejects: int = 0

    @property
    def zone(self) -> str:
        return self.config.get("timezone.storage")


def _counts(r) -> str:
    return f"{r.n_events} (" + ", ".join(f"{s}: {r[f'n_{s.lower()}']}" for s in reversed(SEVERITIES)) + ")"


def algorithm_rows(config: Config) -> list[tuple]:
    on = set(config.enabled())
    return [
        (a, name, ASPECTS[a[4]], "有効" if a in on else "無効", ", ".join(f"{k}={v}" for k, v in config.of_algorithm(a).items()) or "-")
        for a, name in ALGORITHM_NAMES.items()
    ]


def _notes(facts: Facts, chapter: int) -> list[str]:
    out = [f"## {chapter}. 実行時の注意事項", ""]
    parts = [(*NOTES[k], rows) for k, rows in (("rejects", facts.rejects), ("skips", facts.skips), ("failures", facts.failures))]
    for i, (title, head, rows) in enumerate(parts, 1):
        out += [f"### {chapter}.{i} {title}", "", *(table(head, rows) if rows else [NOTHING]), ""]
        if i == 1 and facts.more_rejects:
            out += [MORE.format(n=facts.more_rejects), ""]
    return out


def _run_rows(facts: Facts) -> list[tuple]:
    return [
        ("実行日時", stamp(facts.now, facts.zone)), ("対象ディレクトリ", facts.target),
        ("対象期間", f"{stamp(facts.period[0], facts.zone)} 〜 {stamp(facts.period[1], facts.zone)}"),
        ("読み込んだファイル数", facts.files), ("総レコード数", f"{facts.records:,}"),
    ]


def host_report(facts: Facts, host: str, ym: str, counts, digest: list, texts: Iterator[str]) -> str:
    month = f"{ym[:4]}-{ym[4:]}"
    rows = [(d.metric, d.n_severe, d.n_fatal, d.n_warn, d.n_events, ", ".join(d.algorithms)) for d in digest]
    lines = [
        f"# {host} {month} の異常検知レポート", "", "## 1. このホストの集計", "",
        *table(("項目", "値"), [("ホスト", host), ("対象年月", month), ("検知イベント数", _counts(counts))]), "",
        *table(("メトリクス", "SEVERE", "FATAL", "WARN", "計", "検知手法"), rows), "", "## 2. 実行サマリ", "",
        *table(("項目", "値"), [*_run_rows(facts), ("系列数(全体)", facts.series), ("サマリ", f"report_summary_{ym}.md")]), "",
        "## 3. 適用したアルゴリズム", "", *table(("ID", "名称", "観点", "状態", "主なパラメータ"), algorithm_rows(facts.config)), "", "## 4. 検知イベント", "",
    ]
    for text in texts:
        lines += [text, ""]
    return "\n".join([*lines, *_notes(facts, 5)]).rstrip() + "\n"


def _abbreviated(items: list[str]) -> str:
    return ", ".join(items[:LISTED]) + (f" ほか {len(items) - LISTED} 件" if len(items) > LISTED else "")


def summary_report(facts: Facts, ym: str, events: DataFrame, names: DataFrame) -> str:
    """A month's summary, of bounded length: tables show their foremost rows only."""
    every_host = events.select("host").distinct().count()
    hosts = rollups.top_metrics(events).limit(HOST_ROWS)
    name_of = {r.host: r["name"] for r in names.join(hosts.select("host"), "host", "left_semi").collect()}
    hosts = hosts.collect()
    total = events.agg(F.count("*").alias("n_events"), *rollups._counts()).first()
    lines = [
        f"# 異常検知サマリ {ym[:4]}-{ym[4:]}", "", "## 1. 実行サマリ", "",
        *table(("項目", "値"), [*_run_rows(facts), ("ホスト数", every_host), ("系列数", facts.series), ("検知イベント数", _counts(total) if hosts else "0 (SEVERE: 0, FATAL: 0, WARN: 0, INFO: 0)")]), "",
        "## 2. ホスト別の集計", "",
    ]
    if hosts:
        head = ("ホスト", "SEVERE", "FATAL", "WARN", "計", "主なメトリクス", "レポート")
        lines += table(head, [(h.host, h.n_severe, h.n_fatal, h.n_warn, h.n_events, ", ".join(h.metrics), f"report_{name_of[h.host]}_{ym}.md") for h in hosts])
        if every_host > HOST_ROWS:
            lines += ["", MORE_HOSTS.format(n=every_host - HOST_ROWS, shown=HOST_ROWS, ym=ym)]
    else:
        lines.append(NONE_FOUND)
    days = events.select(F.to_date("start_ts")).distinct().count()
    weekly = days > rollups.LATEST_DAYS
    unit = "週" if weekly else "日"
    lines += ["", f"## 3. {unit}別のイベント数", ""]
    if hosts:
        buckets = rollups.periods(events).collect()
        lines += table((unit, "SEVERE", "FATAL", "WARN", "計"), [(b.bucket if weekly else b.bucket[5:], b.n_severe, b.n_fatal, b.n_warn, b.n_events) for b in buckets])
        every = rollups.weekly(events).count() if weekly else days
        if every > rollups.TOP_ROWS:
            lines += ["", MORE_PERIODS.format(n=every, unit=unit, shown=rollups.TOP_ROWS)]
    else:
        lines.append(NONE_FOUND)
    lines += ["", "## 4. 複数ホストで同時に発生したアノマリー", ""]
    cross = cross_host_groups(events)
    rows = cross.limit(CROSS_ROWS).collect()
    if rows:
        lines += table(("時間帯", "ホスト数", "イベント数", "関与したホスト", "主なメトリクス"), [(g.started, len(g.hosts), g.n_events, _abbreviated(g.hosts), _abbreviated(g.metrics)) for g in rows])
        if (n := cross.count()) > CROSS_ROWS:
            lines += ["", MORE_CROSS.format(n=n - CROSS_ROWS, shown=CROSS_ROWS)]
    else:
        lines.append(NO_CROSS)
    return "\n".join([*lines, "", *_notes(facts, 5)]).rstrip() + "\n"


def digest_of(events: DataFrame) -> DataFrame:
    names = events.select("host", rollups.month().alias("ym"), "metric", F.explode("algorithms").alias("a"))
    names = names.groupBy("host", "ym", "metric").agg(F.array_sort(F.collect_set("a")).alias("algorithms"))
    return rollups.host_digest(events).join(names, ["host", "ym", "metric"])


def write_reports(facts: Facts, events: DataFrame, out: str | Path, sink: Callable[[Path, str], str | None] | None = None) -> list[str]:
    """All reports of a run, each given to sink, which writes it by default.

    Reports of earlier runs stay; a summary is written even without events.
    """
    if sink is None:
        sink = write_text
        try:
            Path(out).mkdir(parents=True, exist_ok=True)
        except OSError as e:
            raise WriteError(f"{out}: {e}") from e
    names = file_names(events)
    figures = F.array_sort(F.collect_list(F.struct((-F.col("n_severe")).alias("a"), (-F.col("n_events")).alias("b"), "metric", "n_severe", "n_fatal", "n_warn", "n_events", "algorithms")))
    digest = digest_of(events).groupBy("host", "ym").agg(figures.alias("digest"))  # a row a metric
    heads = rollups.host_months(events).join(digest, ["host", "ym"]).join(names, "host").orderBy("ym", "host").toLocalIterator()
    ordered = rendered(events, facts.zone).orderBy("ym", "host", "rank", "start_us", "event_id")
    written, texts, head = [], [], None

    def close():
        if head is not None:
            written.append(sink(Path(out) / f"report_{head['name']}_{head.ym}.md", host_report(facts, head.host, head.ym, head, head.digest, iter(texts))))

    for r in ordered.toLocalIterator():  # the driver holds one report's texts
        if head is None or (r.host, r.ym) != (head.host, head.ym):
            close()
            head, texts = next(heads), []
        texts.append(r.text)
    close()
    last = facts.period[1] or facts.now
    months = [r.ym for r in events.select(rollups.month().alias("ym")).distinct().orderBy("ym").collect()]
    for ym in months or [f"{last:%Y%m}"]:
        written.append(sink(Path(out) / f"report_summary_{ym}.md", summary_report(facts, ym, events.where(rollups.month() == ym), names)))
    return written
