"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of edges but the roots; a root is its component's least node.

    Each round makes large stars, then small stars; the rounds grow with the
    logarithm of the longest path. Hubs are only met in joins of written
    tables, which AQE can split, and in sums that combine before the shuffle. Self-links and
    repeated links do no harm; no edges give no rows. Nodes must not be null.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    links = cut(edges.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        centre = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(centre, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(centre.select("u", F.col("m").alias("v"))).distinct())
