"""Settings: 56 keys in six sections, read from an INI file and validated all at once."""

from __future__ import annotations

import configparser
import re
import zoneinfo
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .schema import ALGORITHMS, SAR_ACTIVITIES, SEVERITIES, SOURCES


@dataclass(frozen=True)
class Setting:
    section: str
    key: str
    default: Any
    low: float | None = None
    high: float | None = None
    #: Whether the bound itself is not allowed.
    above: bool = False
    below: bool = False

    @property
    def name(self) -> str:
        return f"{self.section}.{self.key}"

    def parse(self, raw: str) -> Any:
        if isinstance(self.default, bool):
            word = raw.strip().lower()
            if word in ("on", "true", "yes", "1"):
                return True
            if word in ("off", "false", "no", "0"):
                return False
            raise ValueError
        return type(self.default)(raw.strip())

    def fits(self, value: Any) -> bool:
        if isinstance(value, (bool, str)):
            return True
        low = self.low is None or (value > self.low if self.above else value >= self.low)
        return low and (self.high is None or (value < self.high if self.below else value <= self.high))


def _p(key: str, default: Any, low: float | None = None, high: float | None = None, above: bool = False, below: bool = False) -> Setting:
    return Setting("parameters", key, default, low, high, above, below)


# The keys, defaults and bounds that existing settings files rely on.
SETTINGS: tuple[Setting, ...] = (
    *(Setting("algorithms", a, True) for a in ALGORITHMS),
    _p("ALG-A1.window_minutes", 60, 1, 100000),
    _p("ALG-A1.k_warn", 2.0, 0, above=True),
    _p("ALG-A1.k_fatal", 3.0, 0, above=True),
    _p("ALG-A2.window_minutes", 60, 1, 100000),
    _p("ALG-A2.k", 3.0, 0, above=True),
    _p("ALG-A3.iqr_warn", 1.5, 0, above=True),
    _p("ALG-A3.iqr_fatal", 3.0, 0, above=True),
    _p("ALG-A4.lambda", 0.2, 0, 1, above=True),
    _p("ALG-A4.k", 3.0, 0, above=True),
    _p("ALG-A5.z", 3.0, 0, above=True),
    _p("ALG-A5.min_weeks", 2, 1),
    _p("ALG-B1.short_minutes", 60, 1),
    _p("ALG-B1.long_minutes", 1440, 1),
    _p("ALG-B1.min_run", 60, 1),
    _p("ALG-B2.bucket_minutes", 60, 1),
    _p("ALG-B2.p_warn", 0.05, 0, 1, above=True, below=True),
    _p("ALG-B2.p_fatal", 0.01, 0, above=True),
    _p("ALG-B2.max_buckets", 2000, 100),
    _p("ALG-B3.window_minutes", 360, 1),
    _p("ALG-B3.min_increases", 10, 2),
    _p("ALG-B4.baseline_minutes", 1440, 1),
    _p("ALG-B4.h", 5.0, 0, above=True),
    _p("ALG-B5.min_r2", 0.7, 0, 1),
    _p("ALG-C1.ratio_pct", 90.0, 0, 100, above=True),
    _p("ALG-C1.min_minutes", 360.0, 1),
    _p("ALG-C1.min_spread", 1.5, 1.0),
    _p("common.detect_threads", 0, 0, 64),
    _p("common.min_points", 30, 2),
    _p("common.sigma_floor_ratio", 0.02, 0, 1),
    _p("common.sigma_floor_abs", 0.5, 0),
    _p("events.severe_pct", 90.0, 0, 100, above=True),
    _p("events.merge_gap_minutes", 60, 0),
    Setting("duckdb", "max_memory", "4GB"),
    Setting("duckdb", "temp_directory", "./tmp"),
    Setting("chart", "enabled", True),
    Setting("chart", "min_severity", "FATAL"),
    Setting("chart", "max_per_host", 100, 0, 10000),
    Setting("chart", "max_overlay_per_host", 100, 0, 10000),
    Setting("chart", "pad_ratio", 0.25, 0.0, 10.0),
    Setting("timezone", "storage", "UTC"),
    *(Setting("timezone", s, "UTC") for s in SOURCES),
    Setting("sar", "activities", ",".join(SAR_ACTIVITIES)),
)
#: Pairs of which the first must be greater.
_ORDERED = (
    ("ALG-A1.k_fatal", "ALG-A1.k_warn"),
    ("ALG-A3.iqr_fatal", "ALG-A3.iqr_warn"),
    ("ALG-B1.long_minutes", "ALG-B1.short_minutes"),
    ("ALG-B2.p_warn", "ALG-B2.p_fatal"),
)
_BY_NAME = {s.name: s for s in SETTINGS}


@dataclass
class Config:
    values: dict[str, Any] = field(default_factory=lambda: {s.name: s.default for s in SETTINGS})
    warnings: list[str] = field(default_factory=list)

    def param(self, key: str) -> Any:
        """A key of the parameters section."""
        return self.values[f"parameters.{key}"]

    def get(self, name: str) -> Any:
        return self.values[name]

    def replaced(self, **parameters: Any) -> Config:
        """A copy with other parameters; dots of keys are written as two underscores, dashes as one."""
        out = Config(dict(self.values))
        for k, v in parameters.items():
            name = "parameters." + k.replace("__", ".").replace("ALG_", "ALG-")
            if name not in _BY_NAME:
                raise KeyError(name)
            out.values[name] = v
        return out

    def enabled(self) -> list[str]:
        return [a for a in ALGORITHMS if self.values[f"algorithms.{a}"]]

    def activities(self) -> list[str]:
        asked = {x.strip().lower() for x in self.values["sar.activities"].split(",")}
        return [a for a in SAR_ACTIVITIES if a in asked]

    def zone(self, source: str) -> str:
        return self.values[f"timezone.{source}"]

    def converts(self, source: str) -> bool:
        return self.zone(source) != self.values["timezone.storage"]

    def of_algorithm(self, algorithm: str) -> dict[str, Any]:
        start = f"parameters.{algorithm}."
        return {k.removeprefix(start): v for k, v in self.values.items() if k.startswith(start)}


def validate(config: Config) -> list[str]:
    """Everything that is wrong with the values, not only the first."""
    v = config.values
    wrong = [f"{s.name}: {v[s.name]!r} is out of range" for s in SETTINGS if not s.fits(v[s.name])]
    wrong += [f"{a} must be greater than {b}" for a, b in _ORDERED if not config.param(a) > config.param(b)]
    if not re.fullmatch(r"\d+(\.\d+)?(KB|MB|GB|TB)", v["duckdb.max_memory"], re.IGNORECASE):
        wrong.append(f"duckdb.max_memory: {v['duckdb.max_memory']!r} is no amount of memory")
    if v["chart.min_severity"].upper() not in SEVERITIES:
        wrong.append(f"chart.min_severity: {v['chart.min_severity']!r} is no severity")
    known = zoneinfo.available_timezones()  # Spark itself would take offsets too
    wrong += [f"timezone.{k}: {v[f'timezone.{k}']!r} is no time zone name" for k in ("storage", *SOURCES) if v[f"timezone.{k}"] not in known]
    return wrong


def load(path: str | Path | None) -> Config:
    """Settings from a file; no path or no file gives the defaults. Unknown keys and activities only warn."""
    config = Config()
    if path is None or not Path(path).exists():
        return config
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    try:
        parser.read_string(Path(path).read_bytes().decode("utf-8-sig"))
    except (configparser.Error, UnicodeDecodeError) as e:
        raise ConfigError([f"{path}: {e}"]) from e
    wrong: list[str] = []
    sections = {s.section for s in SETTINGS}
    for section in parser.sections():
        if section not in sections:
            config.warnings.append(f"unknown section [{section}]")
            continue
        for key, raw in parser.items(section):
            setting = _BY_NAME.get(f"{section}.{key}")
            if setting is None:
                config.warnings.append(f"unknown key {section}.{key}")
                continue
            try:
                config.values[setting.name] = setting.parse(raw)
            except ValueError:
                wrong.append(f"{setting.name}: {raw!r} is no {type(setting.default).__name__}")
    config.warnings += _unknown_activities(config.values["sar.activities"].split(","))
    if wrong := wrong + validate(config):
        raise ConfigError(wrong)
    return config


def _unknown_activities(names: Iterable[str]) -> list[str]:
    return [f"unknown activity {x.strip()}" for x in names if x.strip() and x.strip().lower() not in SAR_ACTIVITIES]
