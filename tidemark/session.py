"""Sessions: settings for large runs, and the package for the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on executors that were not started with it on their path.

    Spark serves the archive to executors, also to those that join later.
    """
    context = spark.sparkContext
    there = [os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if str(_ROOT.parent) in there or getattr(context, "_tidemark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(_ROOT.rglob("*.py")):
            out.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(str(path))
    context._tidemark_shipped = True


def session(name: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; settings override what is set here."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a session in
    one process (local[N], as in tests) makes and sets a temporary folder; on a
    cluster it has to be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not path:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """df written once below the shared folder, in buckets by keys: joins, windows and groups by them need no exchange of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def is_dealt(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether df lies in partitions by keys."""
    found = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    return re.match("hashpartitioning\\(" + ", ".join(rf"{k}#\d+L?" for k in keys) + ",", found) is not None


#: Tables below the shared folder that go when the driver ends.
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path for a table below the shared folder; unless it is kept, it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep:
        if not _SCRATCH:
            atexit.register(_sweep)
        _SCRATCH.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return
