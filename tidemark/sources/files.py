"""Finding log files and reading them as rows of fields.

Files are classified by name. A file is decoded as a whole (UTF-8 with or
without a mark, else CP932) and cut into lines and fields where it is read;
everything after that is columns.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Names of log files. The last `_gc_` divides container and host.
NAMES = {
    "db_connection": r"^DBConnection_(?<date>\d{8})\.csv$",
    "lsf_queue": r"^bqueues_(?<host>.+)_(?<date>\d{8})\.txt$",
    "sar": r"^sa-(?<host>.+)-(?<date>\d{8})\.csv$",
    "jvm_gc": r"^(?<container>.+)_gc_(?<host>.+)_(?<date>\d{8})\.txt$",
}
LINES = "file_path string, file_date string, kind string, host string, container string, line_no long, fields array<string>, line string"


def classified(files: DataFrame, path: str = "path") -> DataFrame:
    """files with kind, host, container and file_date by file name; kind is null for other files."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    kind, out = F.lit(None).cast("string"), files
    for k, pattern in reversed(NAMES.items()):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    out = out.withColumn("kind", kind)

    def part(group: str) -> Column:
        value = F.lit(None).cast("string")
        for k, pattern in NAMES.items():
            names = re.findall(r"\?<(\w+)>", pattern)
            if group in names:
                value = F.when(F.col("kind") == k, F.regexp_extract(name, pattern, names.index(group) + 1)).otherwise(value)
        return value

    return out.withColumn("host", part("host")).withColumn("container", part("container")).withColumn("file_date", part("date"))


def local_files(root: str) -> list[str]:
    """All files below a folder, links followed, each real folder visited once."""
    found, seen = [], set()
    for folder, below, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            below.clear()
            continue
        seen.add(real)
        below.sort()
        found += [os.path.join(folder, n) for n in sorted(names)]
    return found


def discover(spark: SparkSession, root: str) -> tuple[DataFrame | None, int, int]:
    """Log files (path, kind, host, container, file_date, content), their number, and that of other files.

    A root that the driver sees as a folder is walked there; any other path is
    listed by Spark's reader. Only classified files are opened.
    """
    ship_package(spark)
    if os.path.isdir(root):
        paths = local_files(root)
        compiled = [re.compile(p.replace("?<", "?P<")) for p in NAMES.values()]
        wanted = [p for p in paths if any(c.match(os.path.basename(p)) for c in compiled)]
        if not wanted:
            return None, 0, len(paths)
        read = spark.read.format("binaryFile").load([Path(p).absolute().as_uri() for p in wanted])
        return classified(read.select("path", "content")), len(wanted), len(paths) - len(wanted)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = classified(read.select("path", "content"))
    counts = files.groupBy(F.col("kind").isNotNull().alias("ours")).count().collect()
    n = {r.ours: r["count"] for r in counts}
    return files.where("kind is not null"), n.get(True, 0), n.get(False, 0)


def _text(content: bytes) -> str | None:
    for encoding in ("utf-8-sig", "cp932"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def _rows(kind: str, text: str) -> Iterator[tuple[list[str], str]]:
    if kind in ("db_connection", "lsf_queue"):
        for fields in csv.reader(io.StringIO(re.sub("\r\n?", "\n", text))):
            yield fields, ",".join(fields)
        return
    for line in text.splitlines():
        line = line.strip()
        if line:
            yield (line.split() if kind == "jvm_gc" else line.lstrip("#").split(";") if line.startswith("#") else line.split(";")), line


def lines_of(files: DataFrame) -> DataFrame:
    """The files' lines. A file that cannot be decoded has one row, with line_no -1."""
    schema = LINES
    rows = files.select("path", "file_date", "kind", "host", "container", "content")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one file's lines at a time
                f = batch.slice(k, 1).to_pylist()[0]
                head = {"file_path": f["path"], "file_date": f["file_date"], "kind": f["kind"], "host": f["host"], "container": f["container"]}
                text = _text(f["content"])
                found = [(-1, [], "")] if text is None else ((i, *r) for i, r in enumerate(_rows(f["kind"], text)))
                held = []
                for n, fields, line in found:
                    held.append(head | {"line_no": n, "fields": fields, "line": line})
                    if len(held) >= 10_000:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    return rows.mapInArrow(run, schema)


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("file_path", "file_date", "kind", "host", "container")] + [("line_no", pa.int64()), ("fields", pa.list_(pa.string())), ("line", pa.string())]
)
