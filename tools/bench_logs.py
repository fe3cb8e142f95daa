"""python tools/bench_logs.py [DAYS]: generate logs of that many days and time the whole run over them.

16 hosts with 6 connection pools each, 2 JVMs, 12 queues and 3 hosts with all sar
activities, a point every 5 minutes: about 2 million table rows in 30 days.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.config import Config  # noqa: E402
from tidemark.plans.run import run  # noqa: E402
from tidemark.schema import SAR_ACTIVITIES  # noqa: E402
from tidemark.session import session  # noqa: E402

START, PER_DAY = datetime(2026, 6, 1), 288
_HEADS = {
    "cpu": "CPU;%user;%system;%iowait;%idle", "memory": "kbmemfree;%memused;%commit", "swap_space": "kbswpfree;%swpused", "io": "tps;rtps;bread/s;bwrtn/s",
    "load": "runq-sz;ldavg-1;ldavg-5;blocked", "swapping": "pswpin/s;pswpout/s", "disk": "DEV;tps;await;%util", "network": "IFACE;rxpck/s;rxkB/s;txkB/s;%ifutil",
    "nfs": "call/s;retrans/s;read/s;write/s;access/s;getatt/s", "nfsd": "scall/s;badcall/s;hit/s;miss/s;sread/s;swrite/s;saccess/s;sgetatt/s",
}


def usual(rng: np.random.Generator, n: int, base: float) -> np.ndarray:
    """A daily wave, quieter weekends, noise, and now and then a spike or a shift."""
    t = np.arange(n)
    weekend = np.where((t // PER_DAY) % 7 >= 5, 0.7, 1.0)
    x = base * (1 + 0.3 * np.sin(2 * np.pi * t / PER_DAY)) * weekend + rng.normal(0, 0.05 * base, n)
    for at in rng.integers(0, n, max(1, n // 4000)):
        x[at : at + rng.integers(1, 6)] *= 3
    if rng.random() < 0.1:
        x[rng.integers(n // 3, n) :] += 0.8 * base
    return np.maximum(x, 0)


def generate(folder: Path, days: int) -> None:
    rng, n = np.random.default_rng(1), days * PER_DAY
    pools = {(f"host{h:02}", f"Pool_{k}"): usual(rng, n, 40).round().astype(int) for h in range(1, 17) for k in range(1, 7)}
    queues = {f"q{k}": [usual(rng, n, b).round().astype(int) for b in (50, 20, 30, 1)] for k in range(12)}
    heaps = {f"app{k:02}": [usual(rng, n, b) for b in (50, 40, 60)] for k in (1, 2)}
    devices = {"cpu": ["-1"], "disk": ["sda", "sdb"], "network": ["eth0", "eth1"]}
    sar = {
        (host, a, d): np.stack([usual(rng, n, 25) for _ in head.split(";")[a in devices :]], axis=1)
        for host in ("web1", "web2", "web3") for a, head in _HEADS.items() for d in devices.get(a, [""])
    }
    for day in range(days):
        rows = range(day * PER_DAY, (day + 1) * PER_DAY)
        stamp = [START + timedelta(minutes=5 * i) for i in rows]
        dash, slash = [f"{s:%Y-%m-%d %H:%M:%S}" for s in stamp], [f"{s:%Y/%m/%d %H:%M:%S}" for s in stamp]
        name = f"{stamp[0]:%Y%m%d}"
        files = {f"DBConnection_{name}.csv": ["time,host,port,datasource,active"] + [f"{slash[j]},{h},7003,{p},{x[i]}" for (h, p), x in pools.items() for j, i in enumerate(rows)]}
        files[f"bqueues_lsf01_{name}.txt"] = ["time," + ",".join(f"{q}_{f}" for q in queues for f in ("NJOBS", "PEND", "RUN", "SUSP"))] + [
            f"{dash[j]}," + ",".join(str(x[i]) for xs in queues.values() for x in xs) for j, i in enumerate(rows)
        ]
        for app, (e, o, m) in heaps.items():
            files[f"{app}_gc_jvm{app[-1]}_{name}.txt"] = ["Timestamp S0 S1 E O M CCS YGC YGCT FGC FGCT GCT"] + [
                f"{slash[j]} {i * 300} 0 0 {e[i]:.2f} {o[i]:.2f} {m[i]:.2f} 50 {i * 2} {i * 0.01:.2f} {i // 500} {i // 500 * 0.1:.2f} {i * 0.01:.2f}" for j, i in enumerate(rows)
            ]
        for host in ("web1", "web2", "web3"):
            lines = []
            for (h, a, d), x in sar.items():
                if h == host:
                    lines.append(f"# hostname;interval;timestamp;{_HEADS[a]}")
                    lead = f"{d};" if d else ""
                    lines += [f"{host};300;{dash[j]} UTC;{lead}" + ";".join(f"{v:.2f}" for v in x[i]) for j, i in enumerate(rows)]
            files[f"sa-{host}-{name}.csv"] = lines
        for f, lines in files.items():
            (folder / f).write_text("\n".join(lines) + "\n")


def main(days: int) -> None:
    assert set(_HEADS) == set(SAR_ACTIVITIES)
    with tempfile.TemporaryDirectory() as top:
        logs = Path(top, "logs")
        logs.mkdir()
        generate(logs, days)
        spark = session("bench-logs", "local[8]", **{"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
        spark.sparkContext.setLogLevel("ERROR")
        began = time.perf_counter()
        a, written = run(spark, str(logs), Config(), str(Path(top, "out")))
        took = time.perf_counter() - began
        charts = len(list(Path(top, "out", "charts").glob("EVT-*.svg")))
        print(json.dumps({"days": days, "seconds": round(took, 1), "metric_rows": a.metrics.count(), "series": a.series.count(), "events": a.events.count(), "charts": charts, "reports": len(written)}))


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 30)
