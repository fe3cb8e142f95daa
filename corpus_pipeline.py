"""From raw documents to token ids: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, quality, simhash
from tidemark.llm.common import documents, drop, scratch, ship_package


def stage(f):
    """A stage that can run on executors that lack the package."""

    @functools.wraps(f)
    def ready(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, docs, sf_dir)

    return ready


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]  # they may have any names
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(0), *others).alias("_row")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": line_dedup.text_length("text")}
    return kept.select(*(new[c] if c in new else F.col("_row")[c].alias(c) for c in docs.columns)).toDF(*docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Executors still hold the workers of other stages, so this one's are kept small.
    return bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), block_bytes=3 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Estimation, hashing and merging are not for SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written to the shared folder and read again; a stage's table goes when the next is written."""
    docs, before = documents(spark, sf_dir), None
    for name, step in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
