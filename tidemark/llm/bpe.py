"""Byte-level BPE by corpus-level merge replay, and decoding.

The corpus comes down to its distinct pre-tokens. Each block of texts asks for
those that it has; equal ones meet in a task, and their bytes form one line of
symbols with an inverted index that leads from each mergeable pair to the
positions where it stands. Merges are replayed in rank order: popping a rank
applies it to all its positions at once and enters only the pairs with the
touched neighbours. So a pre-token is replayed once for the whole corpus. The
answers go back to the blocks that asked, as a file for each of the input's
partitions in the shared folder, and texts are put together from them.

A block finds its answers by the order in which its pre-tokens come first. That
an answer is the right one is seen from its bytes, which are the pre-token's; if
the rows should come in another order the second time, the pre-tokens that have
no answer are replayed where they are.
"""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import scratch, settled

#: Words in one replay: as many as stay in a processor's cache, which is twice as fast as all at once.
TOGETHER = 1500
#: Bytes of text that ask together, and rows of answers sent at once.
BLOCK, ROWS = 32 << 20, 10_000


def _class(of: str) -> str:
    """A class of characters up to U+FFFF, as ranges for a bracket."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    spans = ((ord(every[m.start()]), ord(every[m.end() - 1])) for x in ("[^\ue000-\uffff]", "[\ue000-\uffff]") for m in regex.finditer(f"[{of}&&{x}]+", every, regex.V1))
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


def splitter(pattern: str):
    """The pattern's findall; with letters, numbers and spaces spelled out for a plainer engine, half as slow, where a text has none beyond U+FFFF.

    Patterns with other classes, or set operations, are left as they are.
    """
    whole = regex.compile(pattern).findall
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if part in (r"\p{L}", r"\p{N}", r"\s", r"\S") and not (inside and part == r"\S"):
            named = _class(part.replace(r"\S", r"\s"))
            out.append(named if inside else f"[^{named}]" if part == r"\S" else f"[{named}]")
        elif part[0] == "\\" or part in "{}&~" or (inside and part == "["):
            return whole
        else:
            inside = (inside or part == "[") and part != "]"
            out.append(part)
    plain = re.compile("".join(out)).findall

    def find(text: str) -> list[str]:
        low = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return plain(text) if low else whole(text)

    return find


class ByteBPE:
    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, ranks.splitlines()) if k}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.text_of = {v: str(v) for v in self.bytes_of}
        self.width = np.dtype(np.uint16 if max(self.bytes_of) < 1 << 16 else np.uint32)  # of an id
        self.id_of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # The rank that a pair of tokens merges to, by both ids; and for pairs of bytes as an array.
        self.merged: dict[int, int] = {}
        for k, v in self.ranks.items():
            for i in range(1, len(k)):
                if (a := self.ranks.get(k[:i])) is not None and (b := self.ranks.get(k[i:])) is not None:
                    self.merged[a << 20 | b] = v
        self.rank_of_bytes = np.full((256, 256), -1, np.int64)
        for k, v in self.ranks.items():
            if len(k) == 2:
                self.rank_of_bytes[k[0], k[1]] = v
        self.find = splitter(pattern)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, by one replay of the merges over all words."""
        line = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        n = len(line)
        symbol: list[int] = self.id_of_byte[line].tolist()  # at a position; -1 once merged into its left neighbour
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[ends > 0] - 1] = -1
        before[np.unique(np.concatenate(([0], ends[(ends > 0) & (ends < n)])))[: n or 0]] = -1
        first = np.full(n, -1, np.int64)
        first[:-1] = self.rank_of_bytes[line[:-1], line[1:]] if n else first[:-1]
        first[after < 0] = -1
        after, before = after.tolist(), before.tolist()
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        ranks, at = np.unique(first[order], return_index=True)
        heap = ranks.tolist()  # sorted, so a heap
        index = {r: x.tolist() for r, x in zip(heap, np.split(order, at[1:]), strict=True)} if heap else {}
        rank_of, pop, push = self.merged.get, heapq.heappop, heapq.heappush
        while heap:
            rank = pop(heap)
            shifted = rank << 20
            for i in sorted(index.pop(rank)):
                left, j = symbol[i], after[i]
                if left < 0 or j < 0 or rank_of(left << 20 | symbol[j]) != rank:
                    continue
                symbol[i], symbol[j] = rank, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    r = rank_of(shifted | symbol[k])
                    if r is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            push(heap, r)
                h = before[i]
                if h >= 0:
                    r = rank_of(symbol[h] << 20 | rank)
                    if r is not None:
                        if r in index:
                            index[r].append(h)
                        else:
                            index[r] = [h]
                            push(heap, r)
        out, start = [], 0
        for end in ends.tolist():
            out.append([x for x in symbol[start:end] if x >= 0])
            start = end
        return out

    def encode_word(self, word: str) -> tuple[str, bytes]:
        """Ids as text, and decoded bytes, of a word that has no answer."""
        ids = self.replay([word.encode()])[0]
        return ",".join(map(str, ids)), self.decode(ids)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(ranks, pattern)


class Asked(dict):
    """The pre-tokens of a block that are no token, by when they come first."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.words = ranks, []

    def __missing__(self, word: str) -> None:
        if word.encode() not in self.ranks:  # a word of the vocabulary is one token
            self.words.append(word)
        self[word] = None


class Answers(dict):
    """The encoded pre-tokens of a block: ids as text, and decoded bytes."""

    def __init__(self, bpe: ByteBPE, ids: list[bytes]):
        super().__init__()
        self.bpe, self.ids = bpe, iter(ids)
        self.bytes_of, self.text_of, self.width = bpe.bytes_of.__getitem__, bpe.text_of.__getitem__, bpe.width.char

    def __missing__(self, word: str) -> tuple[str, bytes]:
        data = word.encode()
        rank = self.bpe.ranks.get(data)
        if rank is not None:
            out = str(rank), data
        else:
            ids = memoryview(next(self.ids, b"")).cast(self.width).tolist()
            out = (",".join(map(self.text_of, ids)), data) if b"".join(map(self.bytes_of, ids)) == data else self.bpe.encode_word(word)
        self[word] = out
        return out


def _blocks(batches, column: int, block_bytes: int) -> Iterator[tuple[bool, pa.RecordBatch, list[str | None]]]:
    """Batches cut where blocks of texts end: whether a block starts, the rows, and their texts. Depends on the rows' order alone."""
    size, starts = 0, True
    for batch in batches:
        texts, at = batch.column(column).to_pylist(), 0
        for i, t in enumerate(texts):
            if size >= block_bytes:
                if i > at:
                    yield starts, batch.slice(at, i - at), texts[at:i]
                size, starts, at = 0, True, i
            size += len(t) if t else 0
        if len(texts) > at:
            yield starts, batch.slice(at), texts[at:]
            starts = False


def _answers(path: str, task: int) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of a partition and their answers in the order asked, as an executor reads them from the shared folder."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    files = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/task={task}", allow_not_found=True))
    held: list[bytes] = []
    block = None
    for name in sorted(f.path for f in files if f.path.endswith(".parquet")):
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["block", "ids"]):
                own = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if b > a:
                        if block is not None and own[a] != block:
                            yield block, held
                            held = []
                        block = int(own[a])
                        held += batch.column(1).slice(a, b - a).to_pylist()
    if block is not None:
        yield block, held


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, block_bytes: int = BLOCK) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Returns keep, n_tokens, ids_sha256 and decoded_sha256, and the ids themselves
    with with_ids. A null or empty text has no ids; repeated rows are encoded one
    by one; other columns are not read. A text of any length is encoded whole; a
    block ends after the text that fills it. Texts are not shuffled, only their
    distinct pre-tokens that are no token by themselves.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    spark = docs.sparkSession
    last = len(keep)
    rows = docs.select(*keep, docs[text].alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:last])
    path = scratch(spark, "bpe-answers")

    def ask(batches):
        bpe, task, block, asked = encoder(ranks, pattern), TaskContext.get().partitionId(), -1, None
        names = ["task", "block", "place", "word"]

        def sent(least: int):
            while len(asked.words) - done[0] >= max(least, 1):
                some = asked.words[done[0] : done[0] + ROWS]
                place = np.arange(done[0], done[0] + len(some), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), task, np.int32)), pa.array(np.full(len(some), block, np.int32)), pa.array(place), pa.array(some)], names)
                done[0] += len(some)

        done = [0]
        for starts, _, texts in _blocks(batches, last, block_bytes):
            if starts:
                if asked is not None:
                    yield from sent(1)
                asked = None  # before the next is made
                block, asked, done[0] = block + 1, Asked(bpe.ranks), 0
            for t in texts:
                if t:
                    collections.deque(map(asked.__getitem__, bpe.find(t)), 0)  # in the order in which they come
            yield from sent(ROWS)
        if asked is not None:
            yield from sent(1)
        asked = None

    def replay(batches):
        bpe = encoder(ranks, pattern)
        width = bpe.width

        def done(held):
            words = pa.chunked_array([b.column(3) for b in held]).combine_chunks()
            own = words.to_pylist()
            new = [i for i, w in enumerate(own) if not i or w != own[i - 1]]
            lists = bpe.replay([own[i].encode() for i in new])
            data = [np.array(x, width).tobytes() for x in lists]
            times = np.diff([*new, len(own)])
            ids = pa.array(data, pa.binary()).take(pa.array(np.repeat(np.arange(len(new)), times)))
            columns = [pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in range(3)]
            return pa.RecordBatch.from_arrays([*columns, ids], ["task", "block", "place", "ids"])

        held, n = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                held.append(batch)
                n += pa.compute.count_distinct(batch.column(3)).as_py()
                if n >= TOGETHER:
                    yield done(held)
                    held, n = [], 0
        if held:
            yield done(held)

    asked = rows.mapInArrow(settled(ask), "task int, block int, place int, word string").repartition("word").sortWithinPartitions("word")
    answers = asked.mapInArrow(settled(replay), "task int, block int, place int, ids binary")
    answers.repartition("task").sortWithinPartitions("task", "block", "place").write.partitionBy("task").parquet(path)

    def run(batches):
        bpe = encoder(ranks, pattern)
        told, block, found, table = _answers(path, TaskContext.get().partitionId()), -1, None, None
        names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for starts, batch, texts in _blocks(batches, last, block_bytes):
            if starts:
                block += 1
                table = None  # before the next is made
                if found is not None and found[0] < block:
                    found = (-1, [])
                while found is None or found[0] < block:
                    found = next(told, (1 << 31, []))
                table = Answers(bpe, found[1] if found[0] == block else [])
            columns = [[], [], [], []]
            for t in texts:
                words = list(map(table.__getitem__, bpe.find(t))) if t else []
                ids = ",".join([x[0] for x in words])
                columns[0].append(ids.count(",") + 1 if ids else 0)
                columns[1].append(hashlib.sha256(ids.encode()).hexdigest())
                columns[2].append(hashlib.sha256(b"".join([x[1] for x in words])).hexdigest())
                if with_ids:
                    columns[3].append(list(map(int, ids.split(","))) if ids else [])
            out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if with_ids:
                out.append(pa.array(columns[3], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), *out], names)
        found = table = None

    return rows.mapInArrow(settled(run), f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Bytes that the ids stand for, as text (bytes that are not UTF-8 are replaced)."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    rows = rows.select(*keep, rows[ids].alias("_ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])

    def run(batches):
        bpe = encoder(ranks, "")
        for batch in batches:
            texts = [bpe.decode(x or []).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "decoded"])

    return rows.mapInArrow(settled(run), f"{fields}, decoded string")
