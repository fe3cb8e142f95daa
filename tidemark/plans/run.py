"""The whole analysis: logs in, events and reports out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import progress
from ..config import Config
from ..errors import WriteError, is_storage
from ..functions.windows import SERIES
from ..operators import co_anomaly, detectors, events, metrics, rollups
from ..schema import DETECTIONS, RATIOS, SKIPS
from ..session import cut, dealt
from ..sources.ingest import Ingested, ingest
from . import charts, report

#: Files with rejects that reports list.
NOTED = 5000
#: Times that a detector is tried over ever smaller parts of the series, at most.
TRIES = 200


@dataclass
class Analysis:
    metrics: DataFrame
    points: DataFrame
    series: DataFrame
    detections: DataFrame
    skips: DataFrame
    events: DataFrame
    #: (algorithm, series, metric, message)
    failures: list[tuple]


def told(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0]


def isolated(algorithm: str, points: DataFrame, series: DataFrame, config: Config, *extra: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], list[tuple]]:
    """A detector's finds and skips, and failures of single series.

    One plan serves all series. Where it fails, it is tried over each half of
    them, and so on down to the series that it fails for; the others lose
    nothing. Failures of storage end the run.
    """
    done, failures, left, tries = [], [], [(series, 0)], 0
    while left:
        part, depth = left.pop()
        own = points if not depth else points.join(part.select(*SERIES), list(SERIES), "left_semi")
        tries += 1
        try:
            found, skipped = detectors.DETECTORS[algorithm](own, part, config, *extra)
            done.append((cut(found), cut(skipped)))
        except Exception as e:  # noqa: BLE001  a detector's failure is a result
            if is_storage(e):
                raise
            names = part.select(*SERIES).limit(2).collect()
            if len(names) == 1 or tries >= TRIES:
                name = tuple(names[0]) if len(names) == 1 else ("*", "*")
                failures.append((algorithm, *name, told(e)))
                progress.warning("S6", f"{algorithm} failed for {' '.join(name)}: {told(e)}")
            elif names:
                bit = F.shiftrightunsigned(F.xxhash64(*SERIES), depth).bitwiseAND(1)
                left += [(cut(part.where(bit == k)), depth + 1) for k in (0, 1)]
            else:
                failures.append((algorithm, "*", "*", told(e)))
    return done, failures


def analyse(frame: DataFrame, config: Config, names: tuple[str, ...] | None = metrics.DETECTABLE) -> Analysis:
    """Events of a metric frame. Stages are written once each, so that none is computed again.

    Detectors run side by side as jobs of one session; series that one fails
    for are recorded, the others go on.
    """
    spark = frame.sparkSession
    m = cut(frame)
    points = dealt(metrics.searchable(m, names), SERIES, "points")  # for all detectors
    series = cut(metrics.catalogue(points))
    ratios = metrics.searchable(m, tuple(RATIOS.values()))

    def one(algorithm: str):
        return isolated(algorithm, points, series, config, *((ratios,) if algorithm == "ALG-C1" else ()))

    workers = int(config.param("common.detect_threads")) or 4
    with ThreadPoolExecutor(workers) as pool:
        tried = list(pool.map(one, config.enabled()))
    found = spark.createDataFrame([], DETECTIONS)
    skipped = spark.createDataFrame([], SKIPS)
    for f, s in (x for done, _ in tried for x in done):
        found, skipped = found.unionByName(f), skipped.unionByName(s)
    merged = cut(events.merge(found, config))
    graded = cut(events.with_severity(merged, m, config))
    explained = cut(co_anomaly.with_causes(co_anomaly.related(graded), config))
    return Analysis(m, points, series, found, skipped, explained, [x for _, failures in tried for x in failures])


def write_charts(a: Analysis, config: Config, out: Path) -> DataFrame:
    """Chart files below out/charts, and the events with the path of theirs."""
    if not config.get("chart.enabled"):
        return a.events
    folder = out / "charts"
    folder.mkdir(parents=True, exist_ok=True)
    drawn = cut(charts.render(a.events, a.points, config, config.get("timezone.storage")))
    for r in drawn.where("svg is not null").toLocalIterator():  # one chart at a time
        report.write_text(folder / f"{chart_name(r.event_id)}.svg", r.svg)
    report.write_text(folder / "no-chart.svg", charts.NO_CHART)
    path = F.concat(F.lit("charts/"), F.regexp_replace("event_id", r'[\\/:*?"<>|]', "_"), F.lit(".svg"))
    named = drawn.select("event_id", F.when(F.col("svg").isNotNull(), path).alias("chart"), "raw")
    return a.events.join(named, "event_id", "left").withColumn("chart", F.coalesce("chart", F.lit("charts/no-chart.svg")))


def chart_name(event_id: str) -> str:
    return "".join("_" if c in '\\/:*?"<>|' else c for c in event_id)


def facts_of(a: Analysis, read: Ingested, root: str, config: Config, now: datetime) -> report.Facts:
    s = metrics.summary(a.metrics).first()
    rejects = [tuple(r) for r in read.rejects.orderBy("file_path", "reason").limit(NOTED).collect()]
    more = max(0, read.rejects.count() - NOTED)
    skips = [tuple(r) for r in rollups.skip_counts(a.skips).orderBy("algorithm", "reason").collect()]
    return report.Facts(now, root, (s.t_min, s.t_max), read.files, read.rows, s.n_series, rejects, skips, a.failures, config, more)


def run(spark: SparkSession, root: str, config: Config, out: str, now: datetime | None = None) -> tuple[Analysis, list[str]]:
    """Read the logs below root, analyse them, and write reports and charts below out.

    Where reports cannot be written, they are printed instead, and WriteError is raised.
    """
    progress.info("S3", f"reading {root}")
    read = ingest(spark, root, config)
    progress.info("S4", f"{read.files} files, {read.ignored} ignored, {read.rows} rows")
    for w in read.warnings:
        progress.warning("S4", w)
    a = analyse(metrics.build(read.tables), config)
    facts = facts_of(a, read, root, config, now or datetime.now())
    progress.info("S5", f"{facts.series} series, {facts.period[0]} to {facts.period[1]}")
    try:
        shown = cut(write_charts(a, config, Path(out)))
        written = report.write_reports(facts, shown, out)
    except (WriteError, OSError) as e:
        report.write_reports(facts, a.events, out, lambda _, text: print(text))
        raise e if isinstance(e, WriteError) else WriteError(str(e)) from e
    progress.info("S9", f"{len(written)} reports")
    return a, written
