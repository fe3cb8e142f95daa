"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, drop, scratch, shared_dir, ship_package  # noqa: F401

#: ASCII white space that separates words: space and the code points 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; null texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return let(
        parts,
        lambda p: F.size(p)
        - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0),
    ).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once below the shared folder, smaller than a checkpoint, and read again; shuffles that nothing needs any more are dropped."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()  # Spark deletes shuffle files when the driver finds that their plans are gone
    return df.sparkSession.read.parquet(path)


def settled(f):
    """f over a task's batches; then the worker, which stays alive while other stages run, gives back what it no longer needs."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
