"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots, for good. The
bytes of each slot are summed, and a small versioned map leads from slots to
shards. Rebalancing edits the map (moves whole slots), never the hash, so only
the records of the moved slots change place. The map is kept between runs: a run
loads its last version, edits that, and appends the next one. A version has one
row per slot, a bound that does not grow with the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch

SLOTS = 4096
#: Finishing moves for each shard at most; the part of the mean by which shards may differ.
FINISH, SLACK = 20, 0.001


def slot_of(docs: DataFrame, slots: int = SLOTS, keys: tuple[str, ...] = ("doc_id", "text")):
    """Virtual slot of a record: a hash of all its keys, so that no single key is hot."""
    return F.pmod(F.xxhash64(*(docs[k] for k in keys)), F.lit(slots)).cast("int")


class SlotMap:
    """A version of a slot-to-shard map; an edit makes the next version."""

    def __init__(self, slots: int = SLOTS, shards: int = 16, version: int = 0, current: list[int] | None = None):
        self.version, self.shards = version, shards
        self.current = [s % shards for s in range(slots)] if current is None else current

    def rebalance(self, weights: dict[int, int], shards: int | None = None) -> int:
        """Edit the map until shards weigh nearly the same; returns the number of moved slots.

        A shard above the mean gives up slots, the largest first, as long as it
        stays at the mean or above. These, and the slots of shards that are no
        more, go, largest first, to the shard that is lightest then. Single slots
        finish the job. Ties go by
        number, so that the same weights always give the same map. Slots stay
        where they are if that evens nothing out, or shards weigh the same but
        for SLACK of the mean.
        """
        shards = shards or self.shards
        old = self.current
        mean = sum(weights.values()) / shards
        weight = lambda slot: weights.get(slot, 0)
        load, mine = [0] * shards, [[] for _ in range(shards)]
        free: list[int] = []
        for slot, shard in enumerate(old):
            if shard >= shards:
                free.append(slot)
            else:
                load[shard] += weight(slot)
                mine[shard].append(slot)
        for shard, slots in enumerate(mine):
            for slot in sorted(slots, key=lambda s: (-weight(s), s)):
                if 0 < weight(slot) <= load[shard] - mean:
                    load[shard] -= weight(slot)
                    free.append(slot)
        new = list(old)
        heap = [(load[s], s) for s in range(shards)]
        heapq.heapify(heap)
        for slot in sorted(free, key=lambda s: (-weight(s), s)):
            total, shard = heapq.heappop(heap)
            new[slot] = shard
            heapq.heappush(heap, (total + weight(slot), shard))
        load, mine = [0] * shards, [set() for _ in range(shards)]
        for slot, shard in enumerate(new):
            load[shard] += weight(slot)
            mine[shard].add(slot)
        for _ in range(FINISH * shards):  # single slots from the heaviest to the lightest, while that evens them out
            high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            slot = min((s for s in mine[high] if 0 < weight(s) < gap), key=lambda s: (abs(2 * weight(s) - gap), s), default=None)
            if slot is None:
                break
            mine[high].discard(slot)
            mine[low].add(slot)
            new[slot] = low
            load[high] -= weight(slot)
            load[low] += weight(slot)
        before = [0] * max(shards, self.shards)
        for slot, shard in enumerate(old):
            before[shard] += weight(slot)
        if shards == self.shards and max(before) - min(before) <= max(SLACK * mean, max(load) - min(load)):
            new = list(old)
        self.version, self.shards, self.current = self.version + 1, shards, new
        return sum(a != b for a, b in zip(old, new, strict=True))

    def save(self, spark: SparkSession, path: str) -> str:
        """Append this version to the map below path."""
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.current)]
        frame = spark.createDataFrame(rows, "virtual_slot int, shard int, shards int")
        frame.coalesce(1).write.parquet(f"{path.rstrip('/')}/version={self.version}")  # a version that is there already is never written over
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A version of the map below path, by default the last; null if there is no map."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return None
        done = [f.getPath() for f in fs.listStatus(hadoop) if fs.exists(f.getPath().suffix("/_SUCCESS"))]
        versions = [int(p.getName().removeprefix("version=")) for p in done if p.getName().startswith("version=")]
        if not versions:
            return None
        version = version or max(versions)
        rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").orderBy("virtual_slot").collect()  # one row a virtual slot
        return cls(len(rows), rows[0].shards, version, [r.shard for r in rows])


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every record into one of the shards by the law `bytes`.

    Returns id, size (UTF-8 bytes of the text plus 1; a null text has none),
    text_crc32 (of the empty text for null), law, shard, slot (the record's
    place in its shard, gapless from 0), grown_shard (null under this law) and
    virtual_slot. Shards differ by less than a virtual slot's size as a rule.
    Equal texts under different ids spread like other records, so a group of
    copies loads no shard; fully repeated rows share a virtual slot. A null id
    hashes like any value. Empty tables give empty results. Texts of any length
    count whole; other columns are not read.

    With map_path, the last version of the map there is loaded, edited for the
    bytes and shards of now, and the next version appended; it has the slots
    that it was made with. Without, the map starts anew and is written to the
    shared folder.
    """
    spark = docs.sparkSession
    path = map_path or scratch(spark, "slot-map", keep=True)
    slot_map = SlotMap.load(spark, path) or SlotMap(slots, shards)
    slots = len(slot_map.current)
    rows = docs.select(
        docs[id].alias("_id"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(docs[text], F.lit(""))).alias("text_crc32"),
        slot_of(docs, slots, (id, text)).alias("virtual_slot"),
    )
    rows = cut(rows)  # narrow; the texts are read once
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    per_slot = {r.virtual_slot: (r.bytes, r.n) for r in sums.collect()}  # at most `slots` rows
    slot_map.rebalance({k: b for k, (b, _) in per_slot.items()}, shards)
    slot_map.save(spark, path)

    filled = [0] * shards
    starts = []
    for v, s in enumerate(slot_map.current):
        starts.append((v, s, filled[s]))
        filled[s] += per_slot.get(v, (0, 0))[1]
    places = spark.createDataFrame(starts, "virtual_slot int, shard int, start long")
    within = Window.partitionBy("virtual_slot").orderBy("_id", "text_crc32", "size")
    return (
        rows.withColumn("_place", F.row_number().over(within) - 1)
        .join(F.broadcast(places), "virtual_slot")  # one row per virtual slot
        .select(
            F.col("_id").alias(id),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("_place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )
