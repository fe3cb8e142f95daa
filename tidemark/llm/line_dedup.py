"""Line dedup with sharded minimal perfect hashes.

Lines are hashed to 128 bits and counted over documents. What is found often
enough goes, by shard of its hash, into compact arrays (64-bit fingerprint,
count, holder) that a minimal perfect hash over the low half indexes. Documents
probe the arrays. Small arrays are broadcast after a check of their size, and
documents stay where they are. Larger ones stay in the shared folder: line
hashes go to the shard that they are of, salted so that a line of many documents
spreads, a task reads its shard's arrays once, and the lines that are to go come
back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, cut, scratch, settled
from .mph import LineTable

MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a shard, about; bytes of arrays up to which they are broadcast; bytes of text probed at once.
SHARD_LINES, BROADCAST_BYTES, BLOCK = 100_000, 32 << 20, 16 << 20
#: Tasks among which a shard's probes are spread.
SALTS = 16
#: Stands for a null id among holders.
NO_ID = -(2**63)


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key: stripped of ASCII white space, A-Z in lower case; null for short keys."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE_CHARS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def text_length(text: str = "text") -> Column:
    """Code points of a text; null for a null text."""
    return F.length(text).cast("long")


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return x[:, 0].copy(), x[:, 1].copy()


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (lo, hi, n, holder): how many ids a line is found under, and the largest of them."""
    rows = docs.select(docs[id].cast("long").alias("_id"), docs[text].alias("_text")).where(F.length("_text") >= min_chars)

    def run(batches):
        for batch in batches:
            ids, counts, found = batch.column(0).to_pylist(), [], []
            for t in batch.column(1):
                mine = {h for line in t.as_py().split("\n") if (h := line_hash(line, min_chars))}
                counts.append(len(mine))
                found += mine
            lo, hi = _halves(found)
            ids = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))], ["id", "lo", "hi"])

    lines = rows.mapInArrow(settled(run), "id long, lo long, hi long")
    return lines.groupBy("lo", "hi").agg(F.countDistinct("id").alias("n"), F.max("id").alias("holder"))


def _shard(lo: np.ndarray, shards: int) -> np.ndarray:
    return ((lo >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def build_tables(counts: DataFrame, path: str, shard_lines: int = SHARD_LINES) -> int:
    """Write the arrays of each shard as a row (shard, bytes, lines) below path; returns the number of shards."""
    counts = cut(counts)
    shards = max(1, -(-counts.count() // shard_lines))
    by_shard = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("lo", 33), F.lit(shards)).cast("int"))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (rows[c].to_numpy().view(np.uint64) for c in ("lo", "hi"))
        # Of lines that share the low half, the first stays here; the others are told by their whole hash.
        holders = rows["holder"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
        n = rows["n"].to_numpy()
        order = np.lexsort((hi, lo))
        lo, hi, n, holders = lo[order], hi[order], n[order], holders[order]
        layer = np.arange(len(lo)) - np.maximum.accumulate(np.where(np.concatenate(([True], lo[1:] != lo[:-1])), np.arange(len(lo)), 0))
        tables = [LineTable.build(lo[layer == k], hi[layer == k], n[layer == k], holders[layer == k]).dumps() for k in range(layer.max() + 1)]
        return pd.DataFrame({"layer": range(len(tables)), "data": tables, "lines": [int((layer == k).sum()) for k in range(len(tables))], "shard": key[0]})

    tables = by_shard.groupBy("shard").applyInPandas(build, "layer int, data binary, lines long, shard int")
    tables.write.partitionBy("shard").parquet(path)
    return shards


def _reader(path: str) -> Callable[[int], list[LineTable]]:
    """Reads a shard's tables from the shared folder, as an executor sees it."""

    def read(shard: int) -> list[LineTable]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        files = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/shard={shard}", allow_not_found=True))
        names = [f.path for f in files if f.path.endswith(".parquet")]
        return [LineTable.loads(x) for n in names for x in pq.ParquetFile(fs.open_input_file(n)).read(["data"]).column(0).to_pylist()]

    return read


def _hashed_lines(texts: list[str | None], min_chars: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of texts; of those with a key: whose each is, its number, and its hash's halves."""
    lines = [(t or "").split("\n") for t in texts]
    digests, where = [], []
    for d, ls in enumerate(lines):
        for k, line in enumerate(ls):
            if h := line_hash(line, min_chars):
                digests.append(h)
                where.append((d, k))
    doc, number = np.array(where, np.int64).reshape(-1, 2).T
    return lines, doc, number, *_halves(digests)


def lines_to_go(docs: DataFrame, path: str, shards: int, min_chars: int, min_docs: int, id: str, text: str) -> DataFrame:
    """Rows (_id, _hash, _gone): for ids and hashes of texts, the numbers of the lines that go, found at the shards."""
    rows = docs.select(docs[id].cast("long").alias("_id"), F.xxhash64(docs[text]).alias("_hash"), docs[text].alias("_text"))

    def ask(batches):
        for whole in batches:
            for batch in _sliced(whole, 2):
                _, doc, number, lo, hi = _hashed_lines(batch.column(2).to_pylist(), min_chars)
                own = pa.array(doc)
                columns = [pa.array(_shard(lo, shards).astype(np.int32)), batch.column(0).take(own), batch.column(1).take(own), pa.array(number), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "_id", "_hash", "line", "lo", "hi"])

    def probe(batches):
        read, held = _reader(path), (-1, [])
        for batch in batches:
            shard, lo, hi = batch.column(0).to_numpy(), *(batch.column(k).to_numpy().view(np.uint64) for k in (4, 5))
            ids = pc.fill_null(batch.column(1), NO_ID).to_numpy(zero_copy_only=False)
            go = np.zeros(len(shard), bool)
            for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if len(part):
                    if held[0] != shard[part[0]]:
                        held = (shard[part[0]], read(int(shard[part[0]])))
                    for table in held[1]:
                        found, n, holder = table.probe(lo[part], hi[part])
                        go[part] |= found & (n >= min_docs) & (holder != ids[part])
            yield batch.filter(pa.array(go)).select(["_id", "_hash", "line"])

    asked = rows.mapInArrow(settled(ask), "shard int, _id long, _hash long, line long, lo long, hi long")
    salted = asked.withColumn("salt", F.pmod("_hash", F.lit(SALTS)))
    at_home = salted.repartition("shard", "salt").sortWithinPartitions("shard").select("shard", "_id", "_hash", "line", "lo", "hi")
    found = at_home.mapInArrow(settled(probe), "_id long, _hash long, line long")
    return found.groupBy("_id", "_hash").agg(F.collect_set("line").alias("_gone"))  # a document's own lines


def _sliced(batch: pa.RecordBatch, column: int):
    """Slices of a batch of about BLOCK bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // BLOCK
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(starts, starts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id: str = "doc_id", text: str = "text",
    digest: bool = False, shard_lines: int = SHARD_LINES, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs with its text cut down to the lines that stay, and n_lines and n_dropped.

    A line key of at least min_chars code points that is found under at least
    min_docs ids loses its lines but in rows of the largest id that holds it,
    where all of them stay; so rows that share an id count once. A null text
    stays null and has one empty line, as an empty one has. A null id counts as
    no document and keeps no line. With digest, only id, n_lines, n_dropped and
    kept_sha256 are returned. Ids are whole numbers. Texts of any length are
    read whole. Columns named n_lines or n_dropped in docs are replaced.
    """
    spark = docs.sparkSession
    path = scratch(spark, "line-tables")
    frequent = line_counts(docs, min_chars, id, text).where(F.col("n") >= min_docs)
    shards = build_tables(frequent, path, shard_lines)
    tables = spark.read.schema("layer int, data binary, lines long, shard int").parquet(path)
    size = tables.agg(F.sum(F.length("data"))).first()[0] or 0
    own = docs.select(docs[id].alias(id), docs[text].alias(text)) if digest else docs.drop("n_lines", "n_dropped")
    added = "n_lines long, n_dropped long" + ", kept_sha256 string" * digest
    schema = T.StructType([*([own.schema[id]] if digest else own.schema), *T._parse_datatype_string(added)])
    names = own.columns
    id_at, text_at = names.index(id), names.index(text)
    if size <= broadcast_bytes:  # the bound is checked
        held: dict[int, list[bytes]] = {}
        for r in tables.select("shard", "data").collect():
            held.setdefault(r.shard, []).append(bytes(r.data))
        sent, rows = spark.sparkContext.broadcast(held), own
    else:
        gone = lines_to_go(docs, path, shards, min_chars, min_docs, id, text)
        whole = own.select(F.struct(*(own[c] for c in names)).alias("_row"), own[id].cast("long").alias("_own"), F.xxhash64(own[text]).alias("_print"))
        joined = whole.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_hash")), "left")
        sent, rows = None, joined.select("_row", "_gone")

    def run(batches):
        tables = {k: [LineTable.loads(x) for x in v] for k, v in sent.value.items()} if sent is not None else {}
        for whole in batches:
            known = None
            if sent is None:
                known = whole.column(1)
                whole = pa.RecordBatch.from_arrays(whole.column(0).flatten(), names)
            at = 0
            for batch in _sliced(whole, text_at):
                yield cut_down(batch, known.slice(at, batch.num_rows).to_pylist() if known is not None else probed(batch, tables))
                at += batch.num_rows

    def probed(batch, tables) -> list[set[int] | None]:
        lines, doc, number, lo, hi = _hashed_lines(batch.column(text_at).to_pylist(), min_chars)
        ids = pc.fill_null(batch.column(id_at).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
        gone: list[set[int] | None] = [None] * len(lines)
        shard = _shard(lo, shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            for table in tables.get(int(shard[part[0]]), ()) if len(part) else ():
                found, n, holder = table.probe(lo[part], hi[part])
                for i in part[found & (n >= min_docs) & (holder != ids[doc[part]])].tolist():
                    gone[doc[i]] = (gone[doc[i]] or set()) | {int(number[i])}
        return gone

    def cut_down(batch, gone):
        lines = [(t or "").split("\n") for t in batch.column(text_at).to_pylist()]
        gone = [set(g) if g else () for g in gone]
        kept = ["\n".join([x for k, x in enumerate(ls) if k not in g] if g else ls) for ls, g in zip(lines, gone, strict=True)]
        counts = [pa.array([len(ls) for ls in lines], pa.int64()), pa.array([len(g) for g in gone], pa.int64())]
        if digest:
            sums = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(id_at), *counts, sums], [id, "n_lines", "n_dropped", "kept_sha256"])
        columns = [pc.if_else(pc.is_valid(c), pa.array(kept, pa.string()), pa.scalar(None, pa.string())) if i == text_at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays([*columns, *counts], [*names, "n_lines", "n_dropped"])

    return rows.mapInArrow(settled(run), schema)
