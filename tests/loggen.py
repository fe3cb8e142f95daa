"""Two weeks of synthetic logs of a few hosts, with known anomalies."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np

START, STEP, DAYS = datetime(2026, 6, 1), 5, 14
N = DAYS * 24 * 60 // STEP
#: series id, metric, and algorithms of which one at least must find it.
PLANTED = (
    ("db_connection/host01:7003/Pool_1", "active_connections", {"ALG-A1", "ALG-A2", "ALG-A3"}),
    ("db_connection/host01:7003/Pool_2", "active_connections", {"ALG-A1", "ALG-A2", "ALG-A4"}),
    ("jvm_gc/app01@host01", "ou", {"ALG-B1", "ALG-B2", "ALG-B3", "ALG-B5"}),
    ("jvm_gc/app01@host01", "mu", {"ALG-B1", "ALG-B2", "ALG-B5"}),
    ("jvm_gc/app02@host02", "eu", {"ALG-B4", "ALG-A4", "ALG-B1"}),
    ("lsf_queue/lsf01/long", "pend", {"ALG-B1", "ALG-B2", "ALG-B5"}),
    ("sar/host01/cpu/-1", "pct_iowait", {"ALG-A1", "ALG-A2"}),
    ("sar/host02/memory/-", "pct_memused", {"ALG-C1"}),
)
CLEAN = ("lsf_queue/lsf01/short", "njobs")


def generate(folder: Path) -> None:
    rng = np.random.default_rng(20260601)
    t = np.arange(N)
    daily = np.sin(2 * np.pi * t / 288)

    def usual(base: float, swing: float, noise: float) -> np.ndarray:
        return base + swing * daily + rng.normal(0, noise, N)

    pool1, pool2 = usual(40, 10, 2), usual(40, 10, 2)
    pool1[2000:2003] *= 10
    pool2[2500:2524] += 30
    saw = (t % 72) / 72
    ou = 40 + 52 * t / N + 8 * saw + rng.normal(0, 0.3, N)
    mu = 55 + 33 * t / N + rng.normal(0, 0.3, N)
    eu = usual(40, 5, 1)
    eu[2600:] += 25
    pend = 1 + 199 * t / N + rng.normal(0, 2, N)
    iowait = np.abs(usual(3, 1, 0.3))
    iowait[2000:2003] *= 10
    used = usual(50, 8, 1)
    used[1500:1700] = 95 + rng.normal(0, 0.5, 200)
    short = usual(20, 5, 1.5)
    flat = usual(30, 4, 1)
    for day in range(DAYS):
        at, rows = START + timedelta(days=day), range(day * 288, (day + 1) * 288)
        name = f"{at:%Y%m%d}"
        stamp = {i: START + timedelta(minutes=STEP * i) for i in rows}
        slash = {i: f"{s:%Y/%m/%d %H:%M:%S}" for i, s in stamp.items()}
        files = {
            f"DBConnection_{name}.csv": ["time,host,port,datasource,active"]
            + [f"{slash[i]},host01,7003,Pool_{k},{round(max(0, x[i]))}" for i in rows for k, x in ((1, pool1), (2, pool2))],
            f"bqueues_lsf01_{name}.txt": ["time,long_NJOBS,long_PEND,long_RUN,long_SUSP,short_NJOBS"]
            + [f"{stamp[i]},{round(pend[i] + 10)},{round(max(0, pend[i]))},10,0,{round(short[i])}" for i in rows],
        }
        for app, host, o, m, e in (("app01", "host01", ou, mu, flat), ("app02", "host02", flat, flat + 1, eu)):
            files[f"{app}_gc_{host}_{name}.txt"] = ["Timestamp S0 S1 E O M CCS YGC YGCT FGC FGCT GCT"] + [
                f"{slash[i]} {i * 300} 0 0 {e[i]:.2f} {o[i]:.2f} {m[i]:.2f} 50 {i * 2} {i * 0.01:.2f} {i // 500} {i // 500 * 0.1:.2f} {i * 0.01:.2f}" for i in rows
            ]
        for host, io, mem in (("host01", iowait, flat), ("host02", np.abs(flat / 10), used)):
            files[f"sa-{host}-{name}.csv"] = (
                ["# hostname;interval;timestamp;CPU;%user;%nice;%system;%iowait;%steal;%idle"]
                + [f"{host};300;{stamp[i]} UTC;-1;{flat[i]:.2f};0;5;{io[i]:.2f};0;{max(0, 95 - flat[i] - io[i]):.2f}" for i in rows]
                + ["# hostname;interval;timestamp;kbmemfree;kbmemused;%memused;%commit"]
                + [f"{host};300;{stamp[i]} UTC;{1000 + flat[i]:.0f};1;{mem[i]:.2f};{mem[i] / 2:.2f}" for i in rows]
            )
        below = folder / f"{at:%m}"
        below.mkdir(parents=True, exist_ok=True)
        for n, lines in files.items():
            (below / n).write_text("\n".join(lines) + "\n")
