"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(n) bits, each with an index of its
own. A code within distance m * r + m - 1 of the query is within r of it in
some segment. Radii therefore grow round by round: each round probes the values
at exactly distance r in every segment, verifies what it meets on whole codes,
and a query is done when its k-th distance is within what is covered. What a
query has met before is told from the codes themselves, without a distinct.

Rows with equal codes are indexed once, with their k least ids: the others
cannot be among the nearest k by (distance, id). Queries with equal codes are
searched once.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, settled

K, EVERY = 10, 20


def sign_code(vector: Column, bits: int) -> list[Column]:
    """The signs of a vector's first `bits` values as words of 64 bits; missing values are no set bits."""
    out = []
    for word in range(-(-bits // 64)):
        part = F.slice(vector, 64 * word + 1, F.lit(64))
        one = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        out.append(F.aggregate(one, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias(f"c{word}"))
    return out


def segments(bits: int, width: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of segments of about `width` bits that do not cross words."""
    out = []
    for word in range(-(-bits // 64)):
        left = min(64, bits - 64 * word)
        n = max(1, round(left / width))
        edges = [left * i // n for i in range(n + 1)]
        out += [(word, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _value(code: list[Column], segment: tuple[int, int, int]) -> Column:
    word, shift, width = segment
    return F.shiftrightunsigned(code[word], shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def top_k(rows: DataFrame, bits: int, queries: DataFrame | None = None, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, distance): the k nearest other rows of each query, by distance, then id.

    queries are rows of the same table (by default those whose id is divisible
    by EVERY) and never meet their own id. Rows without an id or a vector are
    neither found nor searched; missing and NaN values give no set bits. Rows
    with one id are one row, that of the least code. With fewer than k other
    rows there are as many ranks as those. Values beyond the first `bits` of a
    vector are not part of its code. Ties go by id. Other columns are not read.
    """
    words = range(-(-bits // 64))
    names = [f"c{w}" for w in words]

    def of(df: DataFrame) -> DataFrame:
        codes = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), *sign_code(F.col(vector), bits))
        return codes.groupBy("id").agg(F.min(F.struct(*names)).alias("code")).select("id", "code.*")

    if queries is None:
        queries = rows.where(F.col(id) % EVERY == 0)
    wanted = cut(of(queries))
    coded = cut(of(rows))
    within = Window.partitionBy(*names).orderBy("id")
    some = coded.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= k + 1)
    known = cut(some.groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    n = known.count()
    width = min(16, max(8, round(math.log2(max(n, 2)))))
    cuts = segments(bits, width)
    m = len(cuts)
    seg = F.explode(F.array(*(F.struct(F.lit(j).alias("seg"), _value([F.col(c) for c in names], s).alias("value")) for j, s in enumerate(cuts))))
    index = known.select(*names, "ids", seg.alias("s")).select("s.seg", "s.value", *names, "ids")

    best = None
    open_ = cut(wanted.select(*(F.col(c).alias(f"q{i}") for i, c in enumerate(names))).distinct()).withColumn("kth", F.lit(None).cast("int"))
    for r in range(max(w for _, _, w in cuts) + 1):
        # The queries are few rows that become many: they are dealt out before, and never sent whole, whatever their size seems to be.
        probes = open_.repartition(rows.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(settled(_prober(cuts, r, len(names))), ", ".join(["seg int, value long", *(f"q{w} long" for w in words), "kth int"]))
        met = probes.hint("merge").join(index, ["seg", "value"])
        apart = [F.col(f"q{w}").bitwiseXOR(F.col(f"c{w}")) for w in words]
        total = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
        each = [F.bit_count(_value(apart, s)) for s in cuts]
        # The same code is met in other segments too: it counts where it is nearest, in the first of these.
        first = F.lit(True)
        for j, d in enumerate(each):
            first = first & ((F.col("seg") == j) | (d > r) | ((d == r) & (F.col("seg") < j)))
        found = met.withColumn("distance", total).where(first & (F.col("kth").isNull() | (F.col("distance") <= F.col("kth"))))
        found = found.select(*(f"q{w}" for w in words), "distance", F.explode("ids").alias("id"))
        if best is not None:
            found = found.unionByName(best)
        order = Window.partitionBy(*(f"q{w}" for w in words)).orderBy("distance", "id")
        best = cut(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n"))
        kth = best.groupBy(*(f"q{w}" for w in words)).agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        covered = m * r + m - 1
        left = open_.drop("kth").join(kth, [f"q{w}" for w in words], "left").where(F.col("n").isNull() | (F.col("n") <= k) | (F.col("far") > covered))
        open_ = cut(left.select(*(f"q{w}" for w in words), F.when(F.col("n") > k, F.col("far")).cast("int").alias("kth")))
        if open_.isEmpty():
            break

    asked = wanted.select(F.col("id").alias("query_id"), *(F.col(c).alias(f"q{i}") for i, c in enumerate(names)))
    lists = best.groupBy(*(f"q{w}" for w in words)).agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k + 1 at most
    near = asked.join(lists, [f"q{w}" for w in words]).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, F.lit(k)).alias("near"))
    out = near.select("query_id", F.posexplode("near").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.distance").cast("int").alias("distance"))


def _prober(cuts: list[tuple[int, int, int]], r: int, words: int):
    """Rows (seg, value, the query's words, kth) for the values at exactly distance r in each segment."""

    def run(batches):
        for batch in batches:
            code = [batch.column(w).to_numpy().view(np.uint64) for w in range(words)]
            for j, (word, shift, width) in enumerate(cuts):
                if r > width:
                    continue
                flips = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.uint64)
                value = (code[word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                step = max(1, 200_000 // len(flips))
                for at in range(0, len(value), step):
                    own = np.arange(at, min(at + step, len(value)))
                    take = pa.array(np.repeat(own, len(flips)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(take), j, np.int32)),
                            pa.array((value[own][:, None] ^ flips[None, :]).ravel().view(np.int64)),
                            *(batch.column(w).take(take) for w in range(words + 1)),
                        ],
                        ["seg", "value", *(f"q{w}" for w in range(words)), "kth"],
                    )

    return run
