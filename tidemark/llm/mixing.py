"""Mixing sources to target weights by systematic sampling.

Sources share the words of all documents by weight, none beyond a multiple of
its own size. A source's rate, target over size, is each of its documents'
expected number of copies. Along the documents of a source, the expected copies
are summed up; one random offset is added, and a document is emitted once for
each integer that its stretch of the sum crosses. Documents lie in order of
size, so that the copies taken are a systematic sample of every size, and a
source's words miss its target by about its longest document at most. A source
has one offset, a hash of its name and the seed.

The sum is cut into bands of a source (a size class and a hash): band totals
are summed over the few bands, and each band is summed by itself. A hot source
thus spreads over all its bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS, CAP, SPREAD = (5, 2, 1), 3, 64


def _fraction(*parts: Column) -> Column:
    """A number from 0 up to 1 from a hash that any SQL engine has."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def ranked(names: DataFrame) -> DataFrame:
    """names, rows (_source), with _rank from 1 in code point order, null last; no task sees them all."""
    ordered = cut(names.withColumn("_null", F.col("_source").isNull()).repartitionByRange("_null", "_source").withColumn("_part", F.spark_partition_id()))
    before, starts = 0, []
    for r in ordered.groupBy("_part").count().orderBy("_part").collect():  # one row a partition
        starts.append((r["_part"], before))
        before += r["count"]
    known = names.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_source"))
    return ordered.withColumn("_place", place).join(known, "_part").select("_source", (F.col("_place") + F.col("_start")).alias("_rank"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows (_source, source_size, target) from rows (_source, source_size).

    Sources in code point order, null last, take the weights in turn. The
    total is shared by weight; where a share is above cap times the source's
    size, it stops there and the rest is shared again, until none is above.
    Sources are never gathered; each round of sharing is a sum over them.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = ranked(sizes.select("_source")).withColumnRenamed("_source", "_named")
    shares = cut(
        sizes.join(known, F.col("_source").eqNullSafe(F.col("_named")))
        .select("_source", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
        .withColumn("_tight", F.col("_cap") / F.col("_w"))
    )
    total = float(shares.agg(F.sum("source_size")).first()[0] or 0)
    level, n_open = 0.0, -1
    while True:
        open_ = F.col("_tight") >= level
        r = shares.agg(F.sum(F.when(~open_, F.col("_cap"))).alias("capped"), F.sum(F.when(open_, F.col("_w"))).alias("w"), F.count(F.when(open_, 1)).alias("n")).first()
        if r.n in (0, n_open):
            break
        level, n_open = (total - (r.capped or 0.0)) / r.w, r.n
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level)) if n_open > 0 and r.n else F.col("_cap")
    return shares.select("_source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 7, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target, taken and copies.

    Size is the number of words; null and empty texts have 0 and are still
    emitted at their source's rate. A null source is a source of its own, the
    last. Repeated rows and ids count one by one. The same input and seed give
    the same copies. A source without words has target 0 and no copies. Texts
    of any length count whole; other columns are not read.
    """
    rows = cut(
        docs.select(docs[id].alias("_id"), docs[source].alias("_source"), n_words(docs[text]).alias("size"))
        # At most eight classes for each doubling of the size, times SPREAD hashes.
        .withColumn("_class", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))
        .withColumn("_hash", F.floor(_fraction(F.lit(f"band{seed}"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))) * SPREAD).cast("int"))
    )
    bands = cut(rows.groupBy("_source", "_class", "_hash").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")))
    sizes = bands.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    shared = targets(sizes, weights, cap).withColumnRenamed("_source", "_named")
    along = Window.partitionBy("_source").orderBy("_class", "_hash")  # bands, of which a source has a bounded number
    starts = (
        bands.withColumn("_start", F.sum("_n").over(along) - F.col("_n"))
        .join(shared, F.col("_source").eqNullSafe(F.col("_named")))
        .select("_source", "_class", "_hash", "_start", "source_size", "target")
    )
    within = Window.partitionBy("_source", "_class", "_hash").orderBy("size", "_id")
    placed = rows.withColumn("_place", F.row_number().over(within)).alias("r").join(
        starts.alias("b"),
        F.col("r._source").eqNullSafe(F.col("b._source")) & (F.col("r._class") == F.col("b._class")) & (F.col("r._hash") == F.col("b._hash")),
    )
    # All documents of a source expect the same copies, so the prefix sum at a
    # place is the place times the rate; that is exact at any length.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _fraction(F.lit(f"offset{seed}"), F.coalesce(F.col("r._source"), F.lit("null")))
    at = F.col("_start") + F.col("_place")
    crossed = F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)
    return placed.select(
        F.col("_id").alias(id), "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: rows of docs, each as often as it is taken.

    Rows that share an id, also a null one, are taken equally often: as often
    as the most taken of them. Columns of any name are kept.
    """
    id = options.get("id", "doc_id")
    taken = copies(docs, **options).groupBy(F.col(id).alias("_taken")).agg(F.max("copies").alias("_copies")).where("_copies > 0")
    whole = docs.select(docs[id].alias("_id"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    out = whole.join(taken, F.col("_id").eqNullSafe(F.col("_taken")))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_row.*")
