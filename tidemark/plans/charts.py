"""SVG charts of events: the series around the event, and what overlaps with it on a common scale."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.windows import SERIES, inside
from ..operators import rollups

WIDTH, HEIGHT, LEFT, TOP, GAP = 800, 240, 60, 24, 36
COLORS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#8c564b")
NO_CHART = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="60"><text x="20" y="36" font-size="18" fill="#888">[NO CHART]</text></svg>\n'


def _line(values: list[float], low: float, high: float, top: float, color: str) -> str:
    span, step = (high - low) or 1.0, (WIDTH - LEFT - 20) / max(1, len(values) - 1)
    points = " ".join(f"{LEFT + i * step:.1f},{top + HEIGHT - (v - low) / span * HEIGHT:.1f}" for i, v in enumerate(values))
    return f'<polyline fill="none" stroke="{color}" stroke-width="1.2" points="{points}"/>'


def svg(title: str, stamps: list[pd.Timestamp], values: list[float], start, end, overlays: list[tuple[str, list[float]]], zone: str = "UTC") -> str:
    """One panel with the event's span shaded, and one with the overlays from 0 to 1."""
    low, high = min(values), max(values)
    if low == high:
        low, high = low - 1, high + 1
    total = TOP + HEIGHT + GAP + (HEIGHT + GAP if overlays else 0)
    step = (WIDTH - LEFT - 20) / max(1, len(values) - 1)
    inside = [i for i, t in enumerate(stamps) if start <= t <= end] or [0]
    shade = f'<rect x="{LEFT + inside[0] * step - 1:.1f}" y="{TOP}" width="{(inside[-1] - inside[0]) * step + 2:.1f}" height="{HEIGHT}" fill="#fdd"/>'
    out = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{total}" font-size="11" font-family="sans-serif">', f'<text x="{LEFT}" y="16">{escape(title)}</text>', shade,
        f'<rect x="{LEFT}" y="{TOP}" width="{WIDTH - LEFT - 20}" height="{HEIGHT}" fill="none" stroke="#999"/>',
        f'<text x="4" y="{TOP + 10}">{high:.4g}</text><text x="4" y="{TOP + HEIGHT}">{low:.4g}</text>', _line(values, low, high, TOP, COLORS[0]),
    ]
    for i in (0, len(stamps) // 2, len(stamps) - 1):
        anchor = ("start", "middle", "end")[(i > 0) + (i == len(stamps) - 1)]
        out.append(f'<text x="{LEFT + i * step:.1f}" y="{TOP + HEIGHT + 14}" text-anchor="{anchor}">{stamps[i]:%m-%d %H:%M} ({escape(zone)})</text>')
    below = TOP + HEIGHT + GAP
    for k, (name, ys) in enumerate(overlays[: rollups.CHART_OVERLAYS]):
        bottom, top = min(ys), max(ys)
        scaled = [(y - bottom) / (top - bottom) if top > bottom else 0.0 for y in ys]
        out += [_line(scaled, 0, 1, below, COLORS[1 + k]), f'<text x="{LEFT + 4}" y="{below + 12 + 12 * k}" fill="{COLORS[1 + k]}">{escape(name)}</text>']
    return "\n".join([*out, "</svg>", ""])


def render(events: DataFrame, points: DataFrame, config: Config, zone: str = "UTC") -> DataFrame:
    """Rows (event_id, svg, raw) for the chosen events; with too few points svg is null and raw has these."""
    chosen = rollups.chart_windows(rollups.chart_choice(events, config), config)
    main = rollups.chart_points(chosen, points)
    head = chosen.select("event_id", "start_ts", "end_ts", F.concat_ws(" ", *SERIES).alias("title"), F.slice(F.coalesce("co_anomalies", F.array().cast(chosen.schema["co_anomalies"].dataType)), 1, rollups.CHART_OVERLAYS).alias("others"), "from_us", "to_us")
    asked = head.select("event_id", "from_us", "to_us", F.posexplode("others").alias("k", "o")).select("event_id", "from_us", "to_us", "k", F.col("o.event_id").alias("other"))
    named = asked.join(events.select(F.col("event_id").alias("other"), *SERIES), "other")
    near = inside(named, points.select(*SERIES, "us", "value"), SERIES).select("event_id", "k", F.concat_ws(" ", *SERIES).alias("name"), "us", "value")
    grid = near.select("event_id", "k", "name").distinct().join(main.select("event_id", "us"), "event_id")
    aligned = rollups.locf(near, grid, ("event_id", "k", "name"))
    lines = aligned.groupBy("event_id", "k", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "value"))), lambda x: x["value"]).alias("ys"))
    lines = lines.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("k", "name", "ys"))).alias("lines"))
    series = main.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("pts"))  # CHART_POINTS at most
    rows = head.select("event_id", "start_ts", "end_ts", "title").join(series, "event_id", "left").join(lines, "event_id", "left")

    def draw(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                pts = [] if r["pts"] is None else list(r["pts"])
                if len(pts) < rollups.CHART_LEAST:
                    out.append((r["event_id"], None, [(x["ts"], x["value"]) for x in pts]))
                    continue
                overlays = [] if r["lines"] is None else [(x["name"], list(x["ys"])) for x in r["lines"]]
                stamps = [pd.Timestamp(x["ts"]) for x in pts]
                out.append((r["event_id"], svg(r["title"], stamps, [x["value"] for x in pts], r["start_ts"], r["end_ts"], overlays, zone), None))
            yield pd.DataFrame(out, columns=["event_id", "svg", "raw"])

    return rows.mapInPandas(draw, "event_id string, svg string, raw array<struct<ts:timestamp_ntz,value:double>>")
