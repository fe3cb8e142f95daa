"""Log files of all four formats, whole and broken."""

from __future__ import annotations

from datetime import datetime

import pytest

from tidemark.config import Config
from tidemark.errors import NoInputError, NothingReadableError
from tidemark.schema import REJECT_COLUMNS, REJECT_DATE, REJECT_HEADER, REJECT_NUMBER
from tidemark.sources.files import classified, discover, lines_of
from tidemark.sources.ingest import ingest


def write(folder, files: dict[str, str | bytes]):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def read(spark, folder, files, config=None):
    got = ingest(spark, write(folder, files), config or Config())
    return got, {(r.file_path.rsplit("/", 1)[-1], r.reason): r.n for r in got.rejects.collect()}


def at(text):
    return datetime.fromisoformat(text)


def test_names(spark):
    names = [
        "DBConnection_20260601.csv", "bqueues_a_b_20260601.txt", "sa-a-b-20260601.csv", "x_gc_y_gc_host-1_20260601.txt", "x_gc_h_2026.txt", "notes.txt", "DBConnection_1.csv", "bqueues_x_20260601.csv",
    ]
    got = {r.path: (r.kind, r.host, r.container, r.file_date) for r in classified(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got["DBConnection_20260601.csv"] == ("db_connection", None, None, "20260601")
    assert got["bqueues_a_b_20260601.txt"] == ("lsf_queue", "a_b", None, "20260601")
    assert got["sa-a-b-20260601.csv"] == ("sar", "a-b", None, "20260601")
    assert got["x_gc_y_gc_host-1_20260601.txt"] == ("jvm_gc", "host-1", "x_gc_y", "20260601")
    assert all(got[n] == (None,) * 4 for n in names[4:])


def test_discovery_follows_links_once(spark, tmp_path):
    write(tmp_path, {"a/DBConnection_20260601.csv": "h\n", "a/other.log": "x", "b/sa-h-20260601.csv": "#"})
    (tmp_path / "a" / "loop").symlink_to(tmp_path)
    files, n, ignored = discover(spark, str(tmp_path))
    assert (n, ignored, files.count()) == (2, 1, 2)


DB_HEADER = "time,host,port,datasource,active\n"


def test_db_connection(spark, tmp_path):
    good = "2026/06/01 00:00:00,host01, 7003 ,Pool_1,5\n2026/06/01 00:05:00,host01,7003,Pool_1,-\n2026/06/01 00:10:00,host01,7003.9,Pool_1,\n"
    bad = "2026/06/01 00:15:00,host01,7003\n2026-06-01 00:20:00,host01,7003,Pool_1,5\n2026/06/01 00:25:00,host01,x,Pool_1,5\n2026/06/01 00:30:00,host01,7003,Pool_1,nan\n\n2026/13/01 00:00:00,h,1,p,1\n"
    got, rejects = read(spark, tmp_path, {
        "DBConnection_20260601.csv": DB_HEADER + good + bad,
        "DBConnection_20260602.csv": "",
        "DBConnection_20260603.csv": DB_HEADER,
        "DBConnection_20260604.csv": b"\xef\xbb\xbf" + (DB_HEADER + "2026/06/04 00:00:00,h,1,p,1\n").encode(),
        "DBConnection_20260605.csv": (DB_HEADER + "2026/06/05 00:00:00,h,1,p,1\n").replace("\n", "\r\n"),
        "DBConnection_20260606.csv": (DB_HEADER + "2026/06/06 00:00:00,ホスト,1,プール,1\n").encode("cp932"),
        "DBConnection_20260607.csv": b"\xff\xff\x80\x81",
        "DBConnection_20260608.csv": DB_HEADER + '2026/06/08 00:00:00,h,1,"p,q",1\n',
    })
    rows = got.tables["db_connection"].orderBy("ts").collect()
    assert [(r.ts, r.host, r.port, r.datasource, r.active_connections) for r in rows[:3]] == [
        (at("2026-06-01T00:00:00"), "host01", 7003, "Pool_1", 5), (at("2026-06-01T00:05:00"), "host01", 7003, "Pool_1", None), (at("2026-06-01T00:10:00"), "host01", 7003, "Pool_1", None),
    ]
    assert [(r.host, r.datasource) for r in rows[3:]] == [("h", "p"), ("h", "p"), ("ホスト", "プール"), ("h", "p,q")]
    assert rejects == {
        ("DBConnection_20260601.csv", REJECT_COLUMNS): 1, ("DBConnection_20260601.csv", REJECT_DATE): 2, ("DBConnection_20260601.csv", REJECT_NUMBER): 2, ("DBConnection_20260607.csv", REJECT_HEADER): 1,
    }


def test_jvm_gc_layouts(spark, tmp_path):
    util = "Timestamp S0 S1 E O M CCS YGC YGCT FGC FGCT GCT\n2026/06/01 00:00:00 10.5 0.0 1.0 50.0 60.0 70.0 80.0 3 0.1 1 0.2 0.3\n"
    gc18 = "Timestamp S0C\n2026/06/01 00:00:00 10 " + " ".join(str(i) for i in range(1, 18)) + "\n"
    gc17 = "Timestamp S0C\n2026/06/01 00:00:00 10 " + " ".join(str(i) for i in range(1, 17)) + "\n"
    got, rejects = read(spark, tmp_path, {
        "app01_gc_host1_20260601.txt": util + "2026/06/01 00:05:00 10 1 2\n2026/06/01 00:06:00 x 0.0 1.0 50.0 60.0 70.0 80.0 3 0.1 1 0.2 0.3\n2026-06-01 00:07:00 1 0.0 1.0 50.0 60.0 70.0 80.0 3 0.1 1 0.2 0.3\n",
        "app02_gc_host2_20260601.txt": gc18, "app03_gc_host3_20260601.txt": gc17,
        "real01_gc_host9_20260601.txt": "S0C S1C\n" + util.split("\n")[1] + "\n",
        "bad01_gc_host1_20260601.txt": "a b c\n2026/06/01 00:00:00 1 2 3\n", "empty_gc_host1_20260601.txt": "",
    })
    rows = {r.container: r for r in got.tables["jvm_gc"].collect()}
    assert (rows["app01"].gc_format, rows["app01"].eu, rows["app01"].ou, rows["app01"].mu, rows["app01"].ygc, rows["app01"].gct, rows["app01"].oc) == ("gcutil", 50.0, 60.0, 70.0, 3, 0.3, None)
    assert (rows["app02"].gc_format, rows["app02"].s0c, rows["app02"].ou, rows["app02"].ccsu, rows["app02"].ygc, rows["app02"].gct) == ("gc", 1.0, 8.0, 12.0, 13, 17.0)
    assert (rows["app03"].ccsc, rows["app03"].ccsu, rows["app03"].ygc, rows["app03"].gct) == (11.0, None, 12, 16.0)
    assert rows["real01"].gc_format == "gcutil"
    name = "app01_gc_host1_20260601.txt"
    assert rejects == {(name, REJECT_COLUMNS): 1, (name, REJECT_NUMBER): 1, (name, REJECT_DATE): 1, ("bad01_gc_host1_20260601.txt", REJECT_HEADER): 1}


def test_lsf_queue(spark, tmp_path):
    got, rejects = read(spark, tmp_path, {
        "bqueues_grid01_20260601.txt": (
            "time,long_NJOBS,long_PEND,long_RUN,long_SUSP,a_b_RUN,note\n2026-06-01 00:00:00:02,4,1,3,0,7,z\n2026/06/01 00:05:00,5,-,3,0,,z\n"
            "2026-06-01 00:10:00,5,1,3,0\nyesterday,5,1,3,0,1,z\n2026-06-01 00:15:00,5,x,3,0,1,z\n"
        ),
        "bqueues_grid03_20260601.txt": "time,other\n2026-06-01 00:00:00,1\n",
    })
    rows = {(r.queue, r.ts): (r.njobs, r.pend, r.run, r.susp) for r in got.tables["lsf_queue"].collect()}
    assert rows == {
        ("long", at("2026-06-01T00:00:00")): (4, 1, 3, 0), ("a_b", at("2026-06-01T00:00:00")): (None, None, 7, None),
        ("long", at("2026-06-01T00:05:00")): (5, None, 3, 0), ("a_b", at("2026-06-01T00:05:00")): (None, None, None, None),
    }
    name = "bqueues_grid01_20260601.txt"
    assert rejects == {(name, REJECT_COLUMNS): 1, (name, REJECT_DATE): 1, (name, REJECT_NUMBER): 1, ("bqueues_grid03_20260601.txt", REJECT_HEADER): 1}


SAR = """# hostname;interval;timestamp;CPU;%user;%nice;%system;%iowait;%steal;%idle
h;300;2026-06-01 00:00:00 UTC;-1;1.0;0;2.0;3.0;0;94.0
h;300;2026-06-01 00:05:00;0;1.5;0;bad;3.0;0;94.0
h;300;soon;0;1.5;0;1;3.0;0;94.0
h;300
# hostname;interval;timestamp;strange
h;300;2026-06-01 00:00:00;1
# hostname;interval;timestamp;DEV;tps;rd_sec/s;await;%util
h;300;2026-06-01 00:00:00;sda;5;6;7;8
h;300;2026-06-01 00:05:00;;5;6
# hostname;interval;timestamp;runq-sz;plist-sz;ldavg-1;ldavg-5;ldavg-15;blocked
h;300;2026-06-01 00:00:00;2;100;0.5;0.4;0.3;0
"""


def test_sar(spark, tmp_path):
    files = {"sa-web-1-20260601.csv": SAR, "sa-x-20260601.csv": "no header\n"}
    got, rejects = read(spark, tmp_path, files)
    rows = {(r.activity, r.device, r.metric, r.ts.minute): r.value for r in got.tables["sar"].collect()}
    assert rows == {
        ("cpu", "-1", "pct_user", 0): 1.0, ("cpu", "-1", "pct_system", 0): 2.0, ("cpu", "-1", "pct_iowait", 0): 3.0, ("cpu", "-1", "pct_idle", 0): 94.0, ("cpu", "0", "pct_user", 5): 1.5,
        ("disk", "sda", "pct_util", 0): 8.0, ("disk", "sda", "await", 0): 7.0, ("disk", "sda", "tps", 0): 5.0, ("disk", "-", "tps", 5): 5.0,
        ("load", "-", "runq_sz", 0): 2.0, ("load", "-", "ldavg_1", 0): 0.5, ("load", "-", "ldavg_5", 0): 0.4, ("load", "-", "blocked", 0): 0.0,
    }
    assert {r.host for r in got.tables["sar"].select("host").distinct().collect()} == {"web-1"}
    name = "sa-web-1-20260601.csv"
    assert rejects == {(name, REJECT_NUMBER): 1, (name, REJECT_DATE): 1, (name, REJECT_COLUMNS): 1, ("sa-x-20260601.csv", REJECT_HEADER): 1}
    assert len([w for w in got.warnings if "strange" in w]) == 1 and not any("times are marked" in w for w in got.warnings)
    config = Config()
    config.values["timezone.sar"] = "Asia/Tokyo"
    assert any("times are marked UTC" in w for w in read(spark, tmp_path, {}, config)[0].warnings)
    config = Config()
    config.values["sar.activities"] = "disk"
    only, _ = read(spark, tmp_path, {}, config)
    assert {r.activity for r in only.tables["sar"].select("activity").distinct().collect()} == {"disk"}


def test_zones_repeats_and_nothing(spark, tmp_path):
    config = Config()
    config.values["timezone.db_connection"] = "Asia/Tokyo"
    got, _ = read(spark, tmp_path, {
        "b/DBConnection_20260601.csv": DB_HEADER + "2026/06/01 09:00:00,h,1,p,1\n2026/06/01 09:00:00,h,1,p,2\n", "a/DBConnection_20260602.csv": DB_HEADER + "2026/06/01 09:00:00,h,1,p,3\n",
    }, config)
    assert [(r.ts, r.active_connections) for r in got.tables["db_connection"].collect()] == [(at("2026-06-01T00:00:00"), 1)]
    with pytest.raises(NoInputError):
        ingest(spark, write(tmp_path / "none", {"x.log": "x"}), Config())
    with pytest.raises(NothingReadableError):
        ingest(spark, write(tmp_path / "bad", {"DBConnection_20260601.csv": DB_HEADER + "x\n"}), Config())


def test_lines_keep_order(spark, tmp_path):
    write(tmp_path, {"DBConnection_20260601.csv": "a\n" + "\n".join(str(i) for i in range(25000))})
    lines = lines_of(discover(spark, str(tmp_path))[0])
    assert lines.where("line_no > 0 AND fields[0] <> cast(line_no - 1 AS string)").count() == 0 and lines.count() == 25001
