"""The streaming extension over a folder that grows."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

from tidemark.streaming.ewma import hourly, signals


def test_a_shift_signals_and_late_points_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    t0 = datetime(2026, 6, 1)
    values = np.concatenate((20 + rng.normal(0, 1, 600), 40 + rng.normal(0, 1, 120)))
    rows = [("s", "m", t0 + timedelta(minutes=10 * i), float(v)) for i, v in enumerate(values)]
    rows += [("quiet", "m", t, 5.0) for _, _, t, _ in rows]
    schema = "series_id string, metric string, ts timestamp, value double"
    for i in range(0, len(rows), 360):
        spark.createDataFrame(sorted(rows, key=lambda r: r[2])[i : i + 360], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hours = hourly(stream)
    first = hours.writeStream.format("parquet").option("path", str(tmp_path / "hours")).option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start()
    first.awaitTermination(120)
    again = spark.readStream.schema(hours.schema).parquet(str(tmp_path / "hours"))
    second = signals(again).writeStream.format("memory").queryName("signals").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    second.awaitTermination(120)
    got = spark.sql("SELECT * FROM signals ORDER BY hour").collect()
    shift = t0 + timedelta(minutes=6000)
    assert got and {r.series_id for r in got} == {"s"}
    assert sum(r.hour < shift for r in got) <= 2 and any(shift <= r.hour <= shift + timedelta(hours=3) for r in got)
