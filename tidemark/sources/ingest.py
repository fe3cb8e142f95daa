"""A folder of logs as base tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import NoInputError, NothingReadableError
from ..functions.scalars import in_zone
from ..operators.metrics import first_wins
from ..schema import KEYS, SOURCES
from ..session import cut
from . import parsers
from .files import discover, lines_of


#: Warnings that are shown at most.
SHOWN = 100


@dataclass
class Ingested:
    tables: dict[str, DataFrame]
    #: file_path, reason, n
    rejects: DataFrame
    files: int
    ignored: int
    rows: int
    warnings: list[str]


def ingest(spark: SparkSession, root: str, config: Config) -> Ingested:
    """Read, parse, convert to the storage zone, and keep the first of repeated rows.

    Raises NoInputError where no file has a known name, NothingReadableError
    where no row is left.
    """
    files, n_files, ignored = discover(spark, root)
    if files is None or n_files == 0:
        raise NoInputError(f"no log files below {root}")
    lines = cut(lines_of(files))  # files are opened once for all parsers
    tables, rejects = {}, None
    for kind in SOURCES:
        mine = lines.where(F.col("kind") == kind)
        parse = {"db_connection": parsers.db_connection, "jvm_gc": parsers.jvm_gc, "lsf_queue": parsers.lsf_queue}.get(kind)
        rows, bad = parse(mine) if parse else parsers.sar(mine, config.activities())
        if config.converts(kind):
            rows = rows.withColumn("ts", in_zone(F.col("ts"), config.zone(kind), config.get("timezone.storage")))
        tables[kind] = cut(first_wins(rows, KEYS[kind], parsers.ORDER).drop(*parsers.ORDER))
        rejects = bad if rejects is None else rejects.unionByName(bad)
    n = sum(t.count() for t in tables.values())
    if n == 0:
        raise NothingReadableError(f"none of {n_files} files has a readable row")
    ledger = cut(rejects.groupBy("file_path", "reason").agg(F.count("*").alias("n")))
    warnings = cut(parsers.sar_warnings(lines.where("kind = 'sar'"), config.zone("sar")))
    said = [f"{r.message}: {r.file_path}" for r in warnings.orderBy("file_path", "message").limit(SHOWN).collect()]
    left = warnings.count() - len(said)
    if left > 0:
        kinds = warnings.groupBy("message").count().orderBy(F.desc("count"), "message").limit(SHOWN).collect()
        said += [f"{left} more warnings like these; in all:", *(f"{r['count']} times: {r.message}" for r in kinds)]
    return Ingested(tables, ledger, n_files, ignored, n, said)
