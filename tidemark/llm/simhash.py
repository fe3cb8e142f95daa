"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet halfway: leave out one of three blocks
of the 64 bits that holds at least one of the differing bits, and at most two
bits differ in the rest, so that a variant lies within one bit, half the radius,
of either. Every distinct fingerprint therefore emits, for each block left out,
the rest and the variants of the rest with one bit flipped: 132 keys, where
variants within two bits of the whole would be 2081. The shuffle brings equal
keys together; colliding fingerprints are verified on all 64 bits.

A key's fingerprints are never all paired. Small sets are compared at once;
larger ones by what they have in common: members that agree in the block left
out are all linked, others are looked up by the few values of that block within
reach. Each block of keys gives a spanning forest of its links, at most one row
for each fingerprint, and the components come from those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, settled
from .graph import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: First bit and width of the blocks of which one is left out.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Sets of fingerprints up to this size are compared by sliding over the sorted rows.
SMALL = 32
#: Fingerprints whose variants a task makes.
FAN_OUT = 20_000
#: Texts are cut into words by so many bytes, rows are grouped by so many, to bound memory.
PIECE, ROWS = 4 << 20, 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while len(data) - at > PIECE:
        gap = _GAP.search(data, at + PIECE)
        if not gap:
            break
        yield data[at : gap.start()].split()
        at = gap.start()
    yield data[at:].split() if at else data.split()


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of a text: a bit is set where over half of the shingles' hashes have it.

    Shingles count as often as they occur; a text of fewer words has one
    shingle of all its words, a text without words the fingerprint zero.
    """
    counts, n, rest = np.zeros(64, np.int64), 0, []
    for words in _word_lists(text.encode().lower() if text else b""):
        words = rest + words
        if len(words) >= size:
            runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), np.uint64, len(words) - size + 1)
            for i in range(0, len(hashes), 65536):
                part = hashes[i : i + 65536]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        rest = words[max(0, len(words) - size + 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(rest), SEED) if rest else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long."""
    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id, "fp"])

    return rows.mapInArrow(settled(run), f"`{id}` {rows.schema[0].dataType.simpleString()}, fp long")


def _rest(fps: np.ndarray, block: int) -> np.ndarray:
    """The bits outside a block, closed up."""
    at, width = BLOCKS[block]
    low = fps & np.uint64((1 << at) - 1)
    return low | ((fps >> np.uint64(at + width)) << np.uint64(at))


def _block(fps: np.ndarray, block: int) -> np.ndarray:
    at, width = BLOCKS[block]
    return (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)


def _variants(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for part in np.array_split(fps, max(1, len(fps) // 4096)):
            for b, (_, width) in enumerate(BLOCKS):
                flips = np.concatenate(([0], np.uint64(1) << np.arange(64 - width, dtype=np.uint64))).astype(np.uint64)
                keys = ((_rest(part, b)[:, None] ^ flips[None, :]) << np.uint64(2)) | np.uint64(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["key", "fp"]
                )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links as stars."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _link_small(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified links between rows with equal keys, for sets of up to SMALL rows."""
    out = []
    at = np.arange(len(keys))
    for step in range(1, SMALL):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= RADIUS
        out.append((fps[at[near]], fps[at[near] + step]))
    return out


def _link_large(key: int, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within the radius, without comparing all pairs.

    Every member's rest is the key's (a centre) or one bit from it. Members
    with equal blocks are within two bits: linked to the first of them. Blocks
    one bit apart: within three. Two bits apart: linked if one is a centre.
    Three: if both are. Other pairs meet under another key.
    """
    fps = np.unique(fps)
    b = key & 3
    width = BLOCKS[b][1]
    block, rest = _block(fps, b), _rest(fps, b)
    order = np.argsort(block, kind="stable")
    fps, block, centre = fps[order], block[order], rest[order] == np.uint64(key >> 2)
    values, first = np.unique(block, return_index=True)
    out = [(fps, fps[first[np.searchsorted(values, block)]])]
    middle, middle_value = fps[centre], block[centre]  # one centre for each value at most

    def meet(mine, value, others, other_values, bits):
        if not len(mine) or not len(others):
            return
        for flips in combinations(range(width), bits):
            want = value ^ np.uint64(sum(1 << i for i in flips))
            at = np.minimum(np.searchsorted(other_values, want), len(other_values) - 1)
            hit = other_values[at] == want
            if hit.any():
                out.append((mine[hit], others[at[hit]]))

    meet(fps[first], values, fps[first], values, 1)
    meet(middle, middle_value, fps[first], values, 2)
    meet(middle, middle_value, middle, middle_value, 3)
    return out


def _links(batches):
    """Rows come sorted by key. Sets larger than a batch of rows are held together."""

    def linked(keys, fps):
        if not len(keys):
            return None
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        row_size = np.repeat(sizes, sizes)
        pairs = _link_small(keys[row_size <= SMALL], fps[row_size <= SMALL])
        for i in np.flatnonzero(sizes > SMALL):
            pairs += _link_large(int(keys[starts[i]]), fps[starts[i] : starts[i] + sizes[i]])
        if not pairs:
            return None
        a, b = _forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy().view(np.uint64) for i in range(2)))
        n += batch.num_rows
        if n >= ROWS:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))  # the last set may go on
            if (out := linked(keys[:end], fps[:end])) is not None:
                yield out
            held, n = [(keys[end:], fps[end:])], 0
    if held:
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        if (out := linked(keys, fps)) is not None:
            yield out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id, fp, root and component_id.

    Fingerprints within RADIUS bits are linked; component_id is the least id
    reachable over links, root the component's least fingerprint. Null, empty
    and wordless texts have the fingerprint zero and are linked like others.
    Repeated rows give repeated rows. Null ids take part, but no component is
    named by them: component_id is null where all ids are. Texts of any length
    are read whole, piece by piece. Empty tables give no rows.
    """
    fps = cut(fingerprints(docs, id, text, size))
    distinct = cut(fps.groupBy("fp").agg(F.min(id).alias("_least")))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // FAN_OUT))
    keys = distinct.select("fp").repartition(tasks).mapInArrow(settled(_variants), "key long, fp long")
    met = keys.repartition("key").sortWithinPartitions("key").mapInArrow(settled(_links), "a long, b long")
    roots = components(met)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    named = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "root", "component_id")
    return fps.join(classes, "fp")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id names their component; fully repeated rows stay once."""
    groups = near_duplicates(docs, id, text, size)
    kept = groups.where(F.col(id).eqNullSafe(F.col("component_id"))).select(F.col(id).alias("_kept")).distinct()
    return docs.join(kept, docs[id].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates([id, text])
