"""Column functions that detectors, events and sources share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

#: Formats of series ids, from which the host is read.
HOST_PATTERNS = (r"^db_connection/([^/:]+):\d+/.+$", r"^jvm_gc/[^@]+@(.+)$", r"^lsf_queue/([^/]+)/.+$", r"^sar/([^/]+)/.+$")
UNKNOWN_HOST = "unknown"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def host_of(series_id: Column) -> Column:
    found = F.lit(None).cast("string")
    for p in HOST_PATTERNS:
        found = F.coalesce(found, F.nullif(F.regexp_extract(series_id, p, 1), F.lit("")))
    return F.coalesce(found, F.lit(UNKNOWN_HOST))


def effective_sigma(sd: Column, level: Column, config: Config) -> Column:
    """A spread that is never near zero: at least a share of the level and an absolute floor."""
    sd = F.when(sd.isNull() | F.isnan(sd), 0.0).otherwise(sd)
    floor = F.lit(float(config.param("common.sigma_floor_ratio"))) * F.abs(F.coalesce(level, F.lit(0.0)))
    return F.greatest(sd, floor, F.lit(float(config.param("common.sigma_floor_abs"))), F.lit(1e-9))


def graded(x: Column, warn: Column | float, fatal: Column | float) -> Column:
    """A score that is 1 at the warning limit and 2 at the fatal one, 0 below."""
    warn, fatal = (c if isinstance(c, Column) else F.lit(float(c)) for c in (warn, fatal))
    return F.when(x < warn, 0.0).when(fatal <= warn, 1.0).otherwise(1 + (x - warn) / (fatal - warn))


def sampled(values: Column, count: int = 9) -> Column:
    """`count` values at even steps, both ends among them."""
    step = (F.size(values) - 1) / F.lit(float(count - 1))
    picked = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(values, F.bround(i * step, 0).cast("int")))
    return F.when(F.size(values) <= count, values).otherwise(picked)


def in_sample(place: Column, n: Column, count: int = 9) -> Column:
    """Whether the value at a place, counted from 0, is among those that `sampled` takes of n, so that no list of all is needed."""
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    return (n <= count) | F.exists(steps, lambda i: F.bround(i * ((n - 1) / F.lit(float(count - 1))), 0) == place)


def without_repeats(values: Column) -> Column:
    """Without each value that equals the one before it.

    The list is bound to a name first: within the inner function its expression
    would be computed anew for each value, the square of a long run.
    """
    kept = F.transform(F.array(values), lambda a: F.filter(a, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(a, i - 1))))
    return F.get(kept, F.lit(0))


def column_name(name: Column) -> Column:
    """A sar heading as a metric's name: %x is pct_x, and / and - are underscores."""
    return F.lower(F.translate(F.regexp_replace(name, "^%", "pct_"), "/-", "__"))


def in_zone(ts: Column, source: str, target: str) -> Column:
    """A local time of one zone as that of another; the column itself where the zones are one."""
    return ts if source == target else F.convert_timezone(F.lit(source), F.lit(target), ts)
