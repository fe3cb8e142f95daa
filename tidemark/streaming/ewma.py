"""An extension: points as a stream, judged as they come.

Batch detectors look back over whole series. On a stream, hourly means are
formed behind a watermark, and each series keeps a small state: running mean and
variance of its hourly means, and their exponentially weighted mean. An hour
whose weighted mean leaves the control limits is a signal. The two are queries of
their own with a table of hours between them, which later queries can use too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIGNALS = "series_id string, metric string, hour timestamp, value double, z double, limit double"
_STATE = "n long, mean double, m2 double, z double"


def hourly(points: DataFrame, late: str = "1 hour") -> DataFrame:
    """Means by hour of points (series_id, metric, ts, value); what comes later than the watermark is left out."""
    stream = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    means = stream.groupBy("series_id", "metric", F.window("ts", "1 hour")).agg(F.avg("value").alias("value"))
    return means.select("series_id", "metric", F.col("window.start").alias("hour"), "value")


def _scan(rate: float, k: float, warm_up: int):
    factor = rate / (2 - rate)

    def scan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, z = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        out = []
        for row in pd.concat(list(batches)).sort_values("hour").itertuples():
            sd = max(math.sqrt(m2 / n), 0.02 * abs(mean), 0.5) if n else 0.0
            z = rate * row.value + (1 - rate) * z if n else row.value
            limit = k * sd * math.sqrt(factor * (1 - (1 - rate) ** (2 * (n + 1))))
            if n >= warm_up and abs(z - mean) > limit:
                out.append((*key, row.hour, row.value, z, limit))
            n += 1
            step = row.value - mean
            mean += step / n
            m2 += step * (row.value - mean)
        state.update((n, mean, m2, z))
        yield pd.DataFrame(out, columns=["series_id", "metric", "hour", "value", "z", "limit"])

    return scan


def signals(hours: DataFrame, rate: float = 0.2, k: float = 3.0, warm_up: int = 30) -> DataFrame:
    """A stream of the hours at which a series' weighted mean is beyond k standard errors of its mean so far."""
    grouped = hours.groupBy("series_id", "metric")
    return grouped.applyInPandasWithState(_scan(rate, k, warm_up), SIGNALS, _STATE, "append", GroupStateTimeout.NoTimeout)
