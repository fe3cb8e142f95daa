"""Language-model scores by online logistic context mixing.

A text is predicted bit by bit, byte after byte. Contexts (the last 0 to 4
bytes, and the whole word so far) with the byte's bits so far each give a
prediction from counts over the whole corpus; a mixer adds these up in the
logistic domain with weights that are gated by how sure each context is and how
many are known; an adaptive map refines the sum by the order-0 context.

Texts are cut into segments: a word with the white space or end after it, or 32
bytes of a longer word, where the word's context starts anew. The first four
bytes of a segment are predicted from the bytes before alone, the others also
from the segment so far; so a segment's cost is that of its head, eight bytes,
and of its tail, which does not depend on what stands before. Heads and tails
are counted and scored once for each block of text, not once for each place.

What the corpus gives are counts of strings: a context and the byte after it.
Every context has its own counts, however many there are; contexts of words are
told apart by 56-bit hashes. A word context's strings are at most 256 and a
three-byte context's 65,536: those are the groups that meet in a task. So the
model is a table of strings and costs in the shared folder that grows with the
corpus. The most frequent strings, a bounded number, are sent to the workers
with their costs, and the others are joined to the texts.

Mixer and map learn online from all training texts, steps shrinking as evidence
gathers; each string is predicted from counts that lack one of its occurrences.
Partitions learn on their own and are averaged between rounds. Counts, weights
and map stay as they are while texts are scored, so that a text's score does
not hang on the order of texts.

The base score is a unigram model of words. Counts of words are joined, except
for the most frequent ones, a bounded number, which are sent to the workers.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, settled, stored

FOLDS, HELD_OUT = 5, 1
#: Context bytes besides the word; bytes of a segment; predictors; how many of these have a table of all contexts.
SHORT, LONGEST, INPUTS, DENSE = 4, 32, 6, 3
#: Where the table of a short order starts: a slot for each context and node of the bits before.
FIRST = tuple(sum(256 << 8 * j for j in range(k)) for k in range(DENSE + 1))
UNSEEN = 128  # state of a context that has not been seen: even odds
ROUNDS, RATE, CALM, BATCH, CHUNK = 1, 4.0, 100.0, 2048, 1 << 17
SURE, GATES, BUCKETS = 16, INPUTS, 33
#: Word counts, costs of strings, and states of four-byte strings, that are sent to workers at most.
FREQUENT, COMMON, KEYS = 1 << 19, 1 << 20, 1 << 20
#: Bytes of a long text, and of texts, handled at once; strings whose counts a task holds; bytes of input for a task.
PIECE, BLOCK, HELD, TASK_BYTES = 1 << 20, 4 << 20, 1 << 20, 16 << 20
#: First bytes of segments that are counted together.
TOGETHER = 6
EDGE, MARK = b"\xff", 0xFB  # never in UTF-8: what stands before and after a text, and what lengths are added to
#: Bytes are hashed as sums of values times powers of an odd number, whose inverse modulo 2^64 takes the place out.
VALUES = np.random.default_rng(9).integers(0, 2**64, 256, np.uint64)
POWER = 0x9E3779B97F4A7C15
END = 0  # the hash of the empty word, for the ends of texts
#: Kinds of counted rows: strings with up to four bytes of context, strings of segments, words; and segments: whole ones and parts of long words.
KEY, LONG, WORD, SEGMENT, PART, HEAD = range(6)

_STOPS = np.isin(np.arange(256), list(SPACE_CHARS.encode()))
_KEY_BITS = np.uint64((1 << 8 * (SHORT + 1)) - 1)


def fold(id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number below STEP, and of its STEP-th power."""
    out = []
    for b in (base, pow(base, STEP, 1 << 64)):
        powers = np.full(STEP, b, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return tuple(out)


#: Hashes of lines of up to STEP^2 bytes.
STEP = 4096
_FORTH, _BACK = _powers(POWER), _powers(pow(POWER, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers mixed up one to one; zero stays."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _summed(data: np.ndarray) -> np.ndarray:
    """Up to each byte, the sum of values times powers of POWER by place."""
    rest = -len(data) % STEP
    out = VALUES[np.append(data, np.zeros(rest, np.uint8)) if rest else data].reshape(-1, STEP)
    out *= _FORTH[0]
    out *= _FORTH[1][: len(out), None]
    return np.cumsum(out.ravel(), out=out.ravel())


def word_hash(word: bytes) -> int:
    """The hash that Laid gives a word, for words of any length."""
    out = 0
    for at in range(0, len(word), PIECE):
        part = np.frombuffer(word, np.uint8, min(PIECE, len(word) - at), at)
        out += int(_summed(part)[len(part) - 1]) * pow(POWER, at, 1 << 64)
    return int(_mixed(np.array([out % 2**64], np.uint64))[0])


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, where each stands, and which one each of x is."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(x)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n things of each: whose each is, and its number among them."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


class Line:
    """A line of bytes, the first of which are in no part, with hashes of its parts."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, _summed(data)
        self._windows = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self.sums[start + length - 1] - self.sums[start - 1]
        out *= _BACK[0][start % STEP]
        out *= _BACK[1][start // STEP]
        return _mixed(out)

    def _window(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes as a number, the last lowest."""
        return self._windows[at].view(">u8").ravel().astype(np.uint64)

    def tails(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings of the tails of segments: whose each is, its hash (with the predicted byte lowest), its key."""
        own, number = _spread(np.maximum(length - SHORT, 0))
        at = start[own] + SHORT + number
        hashes = self.hashes(start[own], SHORT + number) & np.uint64(2**64 - 256)
        return own, hashes | self.data[at], self._window(at - 7) & _KEY_BITS

    def parts(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Segments as they are, with their lengths."""
        out = np.zeros((len(start), LONGEST + 1), np.uint8)
        own, number = _spread(length)
        out[own, number + 1] = self.data[start[own] + number]
        out[:, 0] = length
        return out.view(f"V{LONGEST + 1}").ravel()


class Laid(Line):
    """Texts, or pieces of them, in one line of bytes, and their segments and words.

    An entry is a piece with the four bytes before it and whether the text ends
    with it; pieces hold whole segments. A segment is whole if it is a word, or
    none, with what ends it.
    """

    def __init__(self, entries: list[tuple[bytes, bytes, bool]]):
        line = b"".join([x for before, piece, ends in entries for x in (before, piece, EDGE * ends)])
        super().__init__(np.frombuffer(line + EDGE * 8, np.uint8))
        size = np.fromiter((len(piece) + ends for _, piece, ends in entries), np.int64, len(entries))
        first = np.cumsum(size + SHORT) - size
        last = first + size - 1
        stop = _STOPS[self.data]
        for k in range(1, SHORT + 1):
            stop[first - k] = False
        stop[last] = True
        stops = np.flatnonzero(stop)
        closes = np.zeros(len(self.data), bool)
        closes[last] = True
        closes = closes[stops]
        start = np.append(first[0], stops[:-1] + 1 + SHORT * closes[:-1])
        length, entry = stops - start + 1, np.cumsum(closes) - closes
        self.word_start, self.word_length, self.word_entry = start, length - 1, entry
        self.whole = np.ones(len(start), bool)
        if length.max() > LONGEST:
            own, number = _spread(-(-length // LONGEST))
            self.whole = (length <= LONGEST)[own]
            start, entry, length = start[own] + LONGEST * number, entry[own], np.minimum(LONGEST, length[own] - LONGEST * number)
        self.start, self.length, self.entry = start, length, entry

    def heads(self) -> np.ndarray:
        """The four bytes before and up to four of each segment; a shorter one has a mark for its length last."""
        size = np.minimum(self.length, SHORT)
        short = (8 * (SHORT - size)).astype(np.uint64)
        return (self._window(self.start - SHORT) >> short) << short | np.where(size < SHORT, MARK + size, 0).astype(np.uint64)


def head_keys(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings of heads: whose each is, and its key: the predicted byte lowest, over it the four bytes before."""
    size = (heads & np.uint64(0xFF)).astype(np.int64) - MARK
    size[(size < 1) | (size >= SHORT)] = SHORT
    own, keys = [], []
    for j in range(SHORT):
        has = np.flatnonzero(size > j)
        own.append(has)
        keys.append((heads[has] >> np.uint64(8 * (SHORT - 1 - j))) & _KEY_BITS)
    return np.concatenate(own), np.concatenate(keys)


def _pieces(text: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """A text's pieces, cut after white space, or after PIECE bytes where there is none."""
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(c, at, at + PIECE) for c in SPACE_CHARS.encode()) + 1
        end = end if end > at else at + PIECE
        yield (EDGE * SHORT + text[max(0, at - SHORT) : at])[-SHORT:], text[at:end], False
        at = end
    yield (EDGE * SHORT + text[max(0, at - SHORT) : at])[-SHORT:], text[at:], True


def _torn(text: bytes) -> bool:
    """Whether a piece of the text ends within a word."""
    return len(text) > PIECE and any(not ends and not _STOPS[piece[-1]] for _, piece, ends in _pieces(text))


def _laid(texts: list[bytes]) -> Iterator[tuple[Laid, np.ndarray]]:
    """Texts as lines of about BLOCK bytes, each with the number of the text that each entry is of."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            owners.append(i)
            size += len(piece[1])
            if size >= BLOCK:
                yield Laid(held), np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield Laid(held), np.array(owners)


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in slices of about BLOCK bytes, with their texts in lower case."""
    texts = batch.column(column).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BLOCK)) + 1, len(sizes))
    at = 0
    for end in ends.tolist():
        if end > at:
            yield batch.slice(at, end - at), [(t or b"").lower() for t in texts.slice(at, end - at).to_pylist()]
        at = end


class Sums:
    """Sums by number, added up when as much again has come."""

    def __init__(self, columns: int, kind: type = np.int64):
        self.columns, self.kind, self.held, self.size, self.last = columns, kind, [], 0, 1 << 16

    def add(self, own: np.ndarray, *columns: np.ndarray, same: np.ndarray | None = None) -> None:
        """same: a column that is the same wherever the number is."""
        self.held.append((own, same, *(c.astype(self.kind) for c in columns)))
        self.size += len(own)
        if self.size > 2 * self.last:
            self.held = [self.whole()]
            self.size = self.last = len(self.held[0][0])

    def whole(self) -> tuple:
        """Numbers in order, what is the same, and sums; nothing is held any more."""
        if not self.held:
            return (np.zeros(0, np.uint64), None, *(np.zeros(0, self.kind) for _ in range(self.columns)))
        columns = [list(x) for x in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        if len(columns[0]) == 1 and self.last == len(columns[0][0]):
            return tuple(x[0] for x in columns)
        own = np.concatenate(columns.pop(0))
        order = np.argsort(own)
        own = own[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        own, same = own[first], columns.pop(0)  # column after column, so that little is held twice
        same = None if same[0] is None else np.concatenate(same)[order[first]]
        sums = []
        while columns:
            sums.append(np.add.reduceat(np.concatenate(columns.pop(0))[order], first) if len(first) else np.zeros(0, self.kind))
        return (own, same, *sums)


_TASK_COUNTS = "kind int, home long, id long, token binary, n long, c long"
_COUNTED = "kind int, id long, n long, m long, c long, key long"


def _batch(schema: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], [f.split()[0] for f in schema.split(", ")])


def _home(keys: np.ndarray) -> np.ndarray:
    """Keys with the farthest of the four bytes put last, so that the contexts of three bytes lie together."""
    return (keys & np.uint64(2**32 - 1)) << np.uint64(8) | keys >> np.uint64(32)


def _counted_rows(kind: int, own: np.ndarray, key: np.ndarray, n: np.ndarray, m: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return _batch(_COUNTED, np.full(len(own), kind, np.int32), (_home(own) if kind == KEY else own).view(np.int64), *(x.astype(np.int64) for x in (n, m, c)), key.view(np.int64))


def _count(batches):
    """Counts of segments, of strings in heads, and of words that are no segments, in texts with their folds.

    What a task holds is summed up before it is given out.
    """
    kinds = {HEAD: 2, SEGMENT: 2, PART: 2, WORD: 1}
    sums = {k: Sums(n, np.int32) for k, n in kinds.items()}  # of 2^30 bytes at most

    def out():
        for kind, n_sums in kinds.items():
            own, parts, *n = sums[kind].whole()
            sums[kind] = Sums(n_sums, np.int32)
            if not len(own):
                continue
            if kind == HEAD:
                keys = Sums(n_sums, np.int32)
                for at in range(0, len(own), 1 << 16):
                    of, found = head_keys(own[at : at + (1 << 16)])
                    keys.add(found, *(x[at : at + (1 << 16)][of] for x in n))
                own, _, *n = keys.whole()
            tokens, home = pa.nulls(len(own), pa.binary()), own
            if parts is not None:
                table = parts.view(np.uint8).reshape(-1, LONGEST + 1)
                size = table[:, 0].astype(np.int32)
                data = table[:, 1:][np.arange(LONGEST) < size[:, None]]
                tokens = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data)])
                home = np.ascontiguousarray(table[:, 1:9]).view("<u8").ravel() & np.uint64((1 << 8 * TOGETHER) - 1)
            yield _batch(_TASK_COUNTS, np.full(len(own), KEY if kind == HEAD else kind, np.int32), home.view(np.int64), own.view(np.int64), tokens, *(x.astype(np.int64) for x in (n[0], n[-1])))
            del own, parts, n, tokens

    def block(laid: Laid, training: np.ndarray, torn: np.ndarray) -> None:
        learned = training[laid.entry]
        which, _, at = _unique(laid.heads())
        sums[HEAD].add(which, *_both(learned, at, len(which)))
        whole = laid.whole & ~torn[laid.entry]
        for kind, some in ((SEGMENT, np.flatnonzero(whole)), (PART, np.flatnonzero(~whole))):
            if len(some):
                start, length = laid.start[some], laid.length[some]
                which, first, at = _unique(laid.hashes(start, length))
                sums[kind].add(which, *_both(learned[some], at, len(which)), same=laid.parts(start[first], length[first]))
        words = np.flatnonzero((laid.word_length >= LONGEST) & (training & ~torn)[laid.word_entry])
        if len(words):
            sums[WORD].add(laid.hashes(laid.word_start[words], laid.word_length[words]), np.ones(len(words), np.int64))

    size = 0
    for batch, texts in itertools.chain.from_iterable(_sliced(b, 0) for b in batches):
        training = batch.column(1).to_numpy() != HELD_OUT
        sums[WORD].add(np.array([END], np.uint64), np.array([training.sum()]))
        torn = np.array([_torn(t) for t in texts], bool)
        for i in np.flatnonzero(torn & training):
            words = texts[i].split()
            sums[WORD].add(np.fromiter(map(word_hash, words), np.uint64, len(words)), np.ones(len(words), np.int64))
        for laid, owners in _laid(texts):
            block(laid, training[owners], torn[owners])
            size += len(laid.data)
            del laid  # before the next is made
            if sum(s.last for s in sums.values()) > HELD or size > 1 << 30:
                yield from out()
                size = 0
    yield from out()


def _both(learned: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each of n things comes in training texts, and in all."""
    return np.bincount(at[learned], minlength=n), np.bincount(at, minlength=n)


def _expand(batches):
    """Strings and words of the segments, summed up as far as a task holds them; other rows as they are."""
    keys, strings, words = Sums(1), Sums(2), Sums(1)

    def out():
        nonlocal keys, strings, words
        own, _, n = keys.whole()
        if len(own):
            none = np.zeros(len(own), np.int64)
            yield _counted_rows(KEY, own, own, n, none, none)
        own, key, n, c = strings.whole()
        if len(own):
            yield _counted_rows(LONG, own, key, n, n, c)
        own, _, n = words.whole()
        if len(own):
            yield _counted_rows(WORD, own, own, n, n, n)
        keys, strings, words = Sums(1), Sums(2), Sums(1)

    for batch in batches:
        kind, own, n, c = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        for k in (KEY, WORD):
            at = np.flatnonzero(kind == k)
            if len(at):
                ids = own[at].view(np.uint64)
                yield _counted_rows(k, ids, ids, n[at], n[at], c[at])
        at = np.flatnonzero((kind == SEGMENT) | (kind == PART))
        if len(at):
            tokens = batch.column(2).take(pa.array(at))
            size = np.diff(np.frombuffer(tokens.buffers()[1], np.int32, len(at) + 1, 4 * tokens.offset)).astype(np.int64)
            line = Line(np.frombuffer(EDGE * 8 + b"".join(tokens.to_pylist()), np.uint8))
            start = 8 + np.cumsum(size) - size
            of, hashes, key = line.tails(start, size)
            strings.add(hashes, n[at][of], c[at][of], same=key)
            keys.add(key, n[at][of])
            word = np.flatnonzero((kind[at] == SEGMENT) & (size > 1) & (n[at] > 0))
            words.add(line.hashes(start[word], size[word] - 1), n[at][word])
            if strings.last + words.last + keys.last > HELD:
                yield from out()
    yield from out()


def _packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """16-bit states: the stretched probability of a one, and how much was seen."""
    stretch = np.clip(np.log((n1 + 0.2) / (n0 + 0.2)), -7.9, 7.9)
    sure = np.minimum(SURE - 1, np.ceil(1.5 * np.log2(n0 + n1 + 1)))
    return np.round((stretch + 8) * 16).astype(np.uint16) | (sure.astype(np.uint16) << 8)


def context_states(own: np.ndarray, n: np.ndarray, less: np.ndarray | None = None) -> np.ndarray:
    """States for the eight bits of each string's last byte, a string a row, from counts n; less is taken out of a string's own.

    Strings are contexts with the byte lowest; whole contexts must be there.
    """
    order = np.argsort(own)
    own, n = own[order], n[order].astype(np.float64)
    less = np.zeros(len(own)) if less is None else less[order]
    out = np.empty((len(own), 8), np.uint16)
    for k in range(8):
        node = own >> np.uint64(8 - k)  # the context and the bits before
        one = ((own >> np.uint64(7 - k)) & np.uint64(1)).astype(np.float64)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))[: len(own)]
        size = np.diff(np.append(first, len(own)))
        total, ones = np.add.reduceat(n, first), np.add.reduceat(n * one, first)
        out[order, k] = _packed(np.repeat(total - ones, size) - less * (1 - one), np.repeat(ones, size) - less * one)
    return out


def _cut(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys with k context bytes."""
    return keys & np.uint64((1 << 8 * (k + 1)) - 1)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a table as binary values."""
    x = np.ascontiguousarray(x)
    size = x.nbytes // max(1, len(x))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, max(size, 1), np.int32)[: len(x) + 1]), pa.py_buffer(x)])


def _unbinary(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint16).reshape(len(column), *shape)


def _state(batches):
    """Rows sorted by id, summed up, with the states of the orders that are counted from them: with all counts, then without an own one."""
    names = ["kind", "id", "n", "m", "c", "key", "states"]

    def done(columns):
        for kind in (KEY, LONG, WORD):
            at = np.flatnonzero(columns[0] == kind)
            if not len(at):
                continue
            own, n, m, c, key = (x[at] for x in columns[1:])
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            n, m, c = (np.add.reduceat(x, first) for x in (n, m, c))
            own, key = own[first], key[first]
            states = pa.nulls(len(own), pa.binary())
            orders = {KEY: range(DENSE, SHORT + 1), LONG: (None,), WORD: ()}[kind]
            if orders:
                table = np.zeros((len(own), 2, len(orders), 8), np.uint16)
                for j, order in enumerate(orders):
                    strings = own.view(np.uint64) if order is None else _cut(key.view(np.uint64), order)
                    table[:, 0, j], table[:, 1, j] = context_states(strings, n), context_states(strings, n, (m > 0).astype(np.float64))
                states = _binary(table)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(own), kind, np.int32), own, n, m, c, key)] + [states], names)

    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= CHUNK:
            columns = list(map(np.concatenate, zip(*held, strict=True)))
            home = columns[1] >> 16
            at = int(np.searchsorted(home, home[-1]))  # the last context may go on
            if at:
                yield from done([c[:at] for c in columns])
            held, size = [[c[at:] for c in columns]], size - at
    if size:
        yield from done(list(map(np.concatenate, zip(*held, strict=True))))


def string_counts(rows: DataFrame) -> DataFrame:
    """Rows (kind, id, n, m, c, key, states) of all strings and words: counts in the training texts, of these at their own places, and in all texts.

    Strings with up to four bytes of context (KEY) also count what lies in
    tails, where segments give the longer context (LONG). Segments are counted
    in tasks, then over all, where those with the same first bytes meet, since
    they share strings; strings are counted by context, and a context's strings
    meet in one task.
    """
    told = rows.select("_text", "_fold").mapInArrow(settled(_count), _TASK_COUNTS).repartition("kind", "home")
    segments = told.groupBy("kind", "home", "id", "token").agg(*(F.sum(c).alias(c) for c in ("n", "c")))
    counted = segments.select("kind", "id", "token", "n", "c").mapInArrow(settled(_expand), _COUNTED)
    whole = counted.repartition(F.shiftrightunsigned("id", 16)).sortWithinPartitions("id")
    return stored(whole.mapInArrow(settled(_state), "kind int, id long, n long, m long, c long, key long, states binary"), "lm-strings")


def short_table(counts: DataFrame) -> np.ndarray:
    """States of the contexts of fewer than DENSE bytes; the number of slots bounds what is gathered."""
    short = counts.where((F.col("kind") == KEY) & (F.col("n") > 0)).groupBy(F.col("key").bitwiseAND((1 << 8 * DENSE) - 1).alias("key")).agg(F.sum("n").alias("n"))
    got = short.toArrow()  # a row for each DENSE bytes at most
    keys, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    out = np.full(FIRST[DENSE], UNSEEN, np.uint16)
    for k in range(DENSE) if len(keys) else ():
        own, at = np.unique(_cut(keys, k), return_inverse=True)
        states = context_states(own, np.bincount(at, n))
        for i in range(8):
            out[_slots(own, k, i)] = states[:, i]
    return out


def _slots(keys: np.ndarray, k: int, i: int) -> np.ndarray:
    """Places in the table of the contexts of k bytes and the i bits before."""
    return FIRST[k] + (((keys >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)) << np.uint64(8) | _node(keys, i)).astype(np.int64)


def _node(keys: np.ndarray, i: int) -> np.ndarray:
    return np.uint64(1 << i) | (keys & np.uint64(0xFF)) >> np.uint64(8 - i)


class Known:
    """States of strings: of the short orders from a table, of the longer ones from rows, or else from those that have been sent."""

    def __init__(self, table: np.ndarray, keys: np.ndarray | None, states: np.ndarray | None):
        self.table, self.keys, self.states = table, keys, states

    def of(self, kind: np.ndarray, keys: np.ndarray, own: np.ndarray, joined: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit: the bit, the node before it, and the states, an order a row. own: the states of those from segments."""
        if joined is None:
            joined = self.states[np.searchsorted(self.keys, keys)]
        longer = np.concatenate((joined, joined[:, -1:]), axis=1)
        longer[kind == LONG, -1] = own
        for i in range(8):
            states = np.empty((INPUTS, len(keys)), np.uint16)
            for k in range(DENSE):
                states[k] = self.table[_slots(keys, k, i)]
            states[DENSE:] = longer[:, :, i].T
            yield ((keys >> np.uint64(7 - i)) & np.uint64(1)).astype(np.int64), _node(keys, i).astype(np.int64), states


def _inputs(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions and the weights that the gate selects, an order a row."""
    sure = (states >> 8).astype(np.int64)
    gate = (sure[1:] > 0).sum(axis=0)
    stretch = (states & 0xFF).astype(np.float32) / 16 - 8
    return stretch, (gate * INPUTS + np.arange(INPUTS)[:, None]) * SURE + sure


def _products(weights: np.ndarray) -> np.ndarray:
    """Weight times prediction by gate, order and state."""
    state = np.arange(SURE << 8)
    stretch = (state & 0xFF).astype(np.float32) / 16 - 8
    return (weights.reshape(GATES * INPUTS, SURE)[:, state >> 8] * stretch).ravel()


def _mixes(states: np.ndarray, products: np.ndarray) -> np.ndarray:
    """The mixed predictions in the logistic domain."""
    at = (states[1:] > 0xFF).sum(axis=0, dtype=np.int32) * np.int32(INPUTS * (SURE << 8))
    z = np.zeros(states.shape[1], np.float32)
    for row in states:
        z += products[at + row]
        at += np.int32(SURE << 8)
    return z


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def _refined(node: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Places in the map."""
    return node * BUCKETS + np.round((np.clip(z, -8, 8) + 8) * (BUCKETS - 1) / 16).astype(np.int64)


FLAT_MAP = np.tile(_squash(np.linspace(-8, 8, BUCKETS)), 256)


class Strings:
    """Strings of the counts with their states: if they are few enough, the keys' are sent; else rows are joined to them."""

    def __init__(self, counts: DataFrame):
        self.context = counts.sparkSession.sparkContext
        self.keys = counts.where(F.col("kind") == KEY).select("key", "states")
        self.rows = counts.where(F.col("kind") != WORD).select("kind", "id", "key", "m", "c", "states")
        self.few = self.keys.count() <= KEYS  # the bound is checked
        if self.few:
            self.rows = self.rows.withColumn("joined", F.lit(None).cast("binary"))
        else:
            self.rows = stored(self.rows.join(self.keys.withColumnRenamed("states", "joined"), "key").select(*self.rows.columns, "joined"), "lm-joined")
        self.table = short_table(counts)

    def sent(self, which: int):
        """What workers need for states with all counts (0), or without an own one (1)."""
        own = states = None
        if self.few:
            got = self.keys.toArrow().combine_chunks()
            own, states = np.zeros(0, np.uint64), np.zeros((0, 2, 8), np.uint16)
            if len(got):
                own = got.column("key").to_numpy().view(np.uint64)
                order = np.argsort(own)
                own, states = own[order], _unbinary(got.column("states").chunk(0), (2, 2, 8))[order, which]
        return self.context.broadcast((self.table, own, states))

    def map(self, f, schema: str, sent, which: int) -> DataFrame:
        """f over chunks of the rows: columns kind, id, key, m, c and what Known.of gives for them."""
        rows = self.rows.where(F.col("m") > 0) if which else self.rows.where(F.col("c") > 0)

        def chunks(batches):
            known, held, size = Known(*sent.value), [], 0

            def whole():
                kind, own, key, m, c = (np.concatenate([x[k] for x in held]) for k in range(5))
                states = np.concatenate([x[5] for x in held])
                joined = None if held[0][6] is None else np.concatenate([x[6] for x in held])
                key = key.view(np.uint64)
                return kind, own.view(np.uint64), key, m, c, known.of(kind, key, states, joined)

            for batch in batches:
                if not batch.num_rows:
                    continue
                kind = batch.column(0).to_numpy()
                long = batch.filter(pa.array(kind == LONG)).column(5)
                states = _unbinary(long, (2, 1, 8))[:, which, 0] if len(long) else np.zeros((0, 8), np.uint16)
                joined = None if batch.column(6).null_count else _unbinary(batch.column(6), (2, 2, 8))[:, which]
                held.append([kind, *(batch.column(k).to_numpy() for k in range(1, 5)), states, joined])
                size += batch.num_rows
                if size >= CHUNK:
                    yield whole()
                    held, size = [], 0
            if held:
                yield whole()

        return rows.mapInArrow(settled(lambda batches: f(chunks(batches))), schema)


def learn_weights(strings: Strings, sent) -> np.ndarray:
    """Mixer weights by online steps over the training texts' strings, averaged over partitions between rounds."""
    weights = np.full(GATES * INPUTS * SURE, 0.3, np.float32)
    for _ in range(ROUNDS):
        start = weights

        def run(chunks, start=start):
            w, mass = start.copy(), np.zeros(len(start))
            for _, own, _, m, _, steps in chunks:
                order, m = np.argsort(_mixed(own)), m.astype(np.float64)
                parts = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
                for bit, _, states in steps:
                    for some in parts:
                        stretch, cell = _inputs(states[:, some])
                        err = (bit[some] - _squash((w[cell] * stretch).sum(axis=0))) * m[some]
                        flat = cell.ravel()
                        slope = np.bincount(flat, (err * stretch).ravel(), len(w))
                        curve = np.bincount(flat, (0.25 * m[some] * stretch**2).ravel(), len(w))
                        mass += curve
                        seen = curve > 0
                        w[seen] += (RATE * slope[seen] / (mass[seen] + CALM)).astype(np.float32)  # steps shrink with the evidence
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at] * mass[at]), pa.array(mass[at])], ["cell", "w", "mass"])

        sums = strings.map(run, "cell long, w double, mass double", sent, 1).groupBy("cell").agg(F.sum("w").alias("w"), F.sum("mass").alias("mass"))
        weights = start.copy()
        for r in sums.collect():  # one row a weight
            weights[r.cell] = r.w / r.mass
    return weights


def learn_maps(strings: Strings, sent, weights: np.ndarray) -> np.ndarray:
    """The refinement: how often a one follows, by order-0 context and mixed prediction, in the training texts."""

    def run(chunks):
        sums, products = np.zeros((2, 256 * BUCKETS)), _products(weights)
        for _, _, _, m, _, steps in chunks:
            for bit, node, states in steps:
                at = _refined(node, _mixes(states, products))
                sums[0] += np.bincount(at, m, 256 * BUCKETS)
                sums[1] += np.bincount(at, m * bit, 256 * BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["cell", "n", "ones"])

    sums = strings.map(run, "cell long, n double, ones double", sent, 1)
    maps = FLAT_MAP.copy()
    for r in sums.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():  # one row a cell of the map
        maps[r.cell] = (r.ones + 20 * maps[r.cell]) / (r.n + 20)
    return maps


def string_bits(steps, weights: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Bits that each string's last byte costs after the bytes before it."""
    out, products = 0.0, _products(weights)
    for bit, node, states in steps:
        z = _mixes(states, products)
        p = np.clip(0.5 * (_squash(z) + maps[_refined(node, z)]), 1e-5, 1 - 1e-5)
        out = out - np.log2(np.where(bit == 1, p, 1 - p))
    return out


def _names(keys: np.ndarray) -> np.ndarray:
    """Strings of heads are named by their keys mixed up one to one, since those of tails are named by hashes."""
    return keys * np.uint64(0x9E3779B97F4A7C15)


def string_costs(strings: Strings, sent, weights: np.ndarray, maps: np.ndarray) -> DataFrame:
    """Rows (word, c, cost): the bits that each string's last byte costs."""

    def run(chunks):
        for kind, own, keys, _, c, steps in chunks:
            names = np.where(kind == KEY, _names(keys), own)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(c), pa.array(string_bits(steps, weights, maps).astype(np.float32))], ["word", "c", "cost"])

    return strings.map(run, "word long, c long, cost float", sent, 0)


class Table:
    """Values by name: each at its place, or with those that another has taken the place of."""

    def __init__(self, names: np.ndarray, values: np.ndarray):
        """The last of the names get their places."""
        self.shift = np.uint64(63 - max(1, len(names)).bit_length())  # two to four places for a name
        place = self._place(names)
        size = 1 << int(64 - self.shift)
        self.names, self.values = np.full(size, 2**63, np.uint64), np.zeros(size, values.dtype)
        self.names[place], self.values[place] = names, values
        lost = np.flatnonzero(self.names[place] != names)
        lost = lost[np.argsort(names[lost])]
        self.lost, self.lost_values = names[lost], values[lost]

    def _place(self, names: np.ndarray) -> np.ndarray:
        return ((names ^ names >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def of(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where the name is not among them, and where that is."""
        place = self._place(names)
        out = self.values[place].astype(np.float64)
        left = np.flatnonzero(self.names[place] != names)
        out[left] = 0.0
        if len(left) and len(self.lost):
            at = np.minimum(np.searchsorted(self.lost, names[left]), len(self.lost) - 1)
            found = self.lost[at] == names[left]
            out[left[found]] = self.lost_values[at[found]]
            left = left[~found]
        return out, left

    def by_part(self, own: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over names of n parts, and the names left out: whose, and which."""
        values, left = self.of(names)
        return np.bincount(own, values, n), own[left], names[left]


_TABLES: dict[str, tuple[Table, Table]] = {}


def _tables(sent) -> tuple[Table, Table]:
    """A worker's base scores of words and costs of strings, the same from task to task."""
    name, *parts = sent.value
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Table(*parts[:2]), Table(*parts[2:])
    return _TABLES[name]


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[float, DataFrame]:
    """A bound, and the rows with more than that count: as many as fit into `most` rows."""
    level = F.floor(F.log2("c") * 8).cast("int")
    bound, n = 0.0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # eight rows for each doubling
        if n + r["count"] > most:
            bound = r.level + 1
            break
        n += r["count"]
    return bound, counts.where(level >= bound)


class Rare:
    """Strings and words of texts that have not been sent, each with how often its text has it."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: np.ndarray, names: np.ndarray) -> None:
        if len(text):
            self.held.append((text, names))

    def add_parts(self, which: np.ndarray, text: np.ndarray, own: np.ndarray, names: np.ndarray, n: int) -> None:
        """names of n parts, whose they are in own, for the texts that have the parts that which names."""
        if len(own):
            order = np.argsort(own, kind="stable")
            names, each = names[order], np.bincount(own, minlength=n)
            has = np.flatnonzero(each[which] > 0)
            parts = which[has]
            of, number = _spread(each[parts])
            self.add(text[has][of], names[(np.cumsum(each) - each)[parts][of] + number])

    def lists(self, n: int) -> list[pa.Array]:
        text, names = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.lexsort((names, text))
        text, names = text[order], names[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (names[1:] != names[:-1]))[: len(text)])
        times = np.diff(np.append(first, len(text)))
        ends = pa.array(np.searchsorted(text[first], np.arange(n + 1)), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (names[first].view(np.int64), times)]


def word_name(hashes):
    """Words among the names of strings."""
    return hashes ^ 0x5DEECE66D1234567


def dealt(docs: DataFrame) -> DataFrame:
    """docs in fewer, larger partitions where they are small, so that a task sums up more before it sends counts; nothing is shuffled."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.coalesce(min(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), 1 << 20))


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Null and empty texts have one token, the end. Rows are scored one by one,
    repeated rows too; a null id's text counts as an empty id's. Without
    training texts every word is unknown and every bit costs one bit. Base
    counts tell words by 64-bit hashes. Texts of any length are read whole, in
    pieces of PIECE bytes; a word of over LONGEST bytes gives context only
    within stretches of so many. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = dealt(docs).select(docs[id].alias("_id"), docs[text].alias("_text"), fold(docs[id]).alias("_fold"))
    counts = string_counts(rows)
    vocabulary = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("id", F.col("n").alias("c"))
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    scale = n + 0.5 * (v + 1)
    bound, common = frequent(vocabulary)
    table = common.toArrow()  # FREQUENT rows at most
    words = table.column("id").to_numpy().view(np.uint64), np.log10((table.column("c").to_numpy() + 0.5) / scale)
    strings = Strings(counts)
    sent = strings.sent(1)
    weights = learn_weights(strings, sent)
    maps = learn_maps(strings, sent, weights)
    sent.destroy()
    sent = strings.sent(0)
    costs = stored(string_costs(strings, sent, weights, maps), "lm-costs")
    sent.destroy()
    rare_bound, often = frequent(costs, COMMON)
    table = often.toArrow()  # COMMON rows at most
    order = np.argsort(table.column("c").to_numpy(), kind="stable")  # the most frequent last: they get their places
    sent_tables = spark.sparkContext.broadcast((uuid.uuid4().hex, *words, table.column("word").to_numpy()[order].view(np.uint64), table.column("cost").to_numpy()[order]))
    del table, order, words

    def run(batches):
        words, costs = _tables(sent_tables)
        for batch, texts in itertools.chain.from_iterable(_sliced(b, 1) for b in batches):
            n = len(texts)
            sums, n_known, n_tokens, bits = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
            rare = Rare()

            def count(text: np.ndarray, which: np.ndarray, at: np.ndarray) -> None:
                """Words of texts: which text's, hashes of the distinct ones, and which one each is."""
                value, left = words.of(which)
                known = np.ones(len(which), bool)
                known[left] = False
                sums[:] += np.bincount(text, value[at], n)
                n_known[:] += np.bincount(text, known[at], n)
                n_tokens[:] += np.bincount(text, minlength=n)
                left = np.flatnonzero(~known[at])
                rare.add(text[left], word_name(which[at[left]]))

            count(np.arange(n), np.array([END], np.uint64), np.zeros(n, np.int64))
            torn = np.array([_torn(t) for t in texts], bool)
            for i in np.flatnonzero(torn):
                split = texts[i].split()
                count(np.full(len(split), i), np.fromiter(map(word_hash, split), np.uint64, len(split)), np.arange(len(split)))
            def block(laid: Laid, owners: np.ndarray) -> None:
                text = owners[laid.entry]
                which, first, at = _unique(laid.hashes(laid.start, laid.length))
                start, length = laid.start[first], laid.length[first]
                # Whole segments are words with what ends them; longer words are counted for themselves.
                some = np.flatnonzero(laid.whole & (laid.length > 1) & ~torn[text])
                has = np.flatnonzero(length > 1)
                place = np.zeros(len(which), np.int64)
                place[has] = np.arange(len(has))
                count(text[some], laid.hashes(start[has], length[has] - 1), place[at[some]])
                some = np.flatnonzero((laid.word_length >= LONGEST) & ~torn[owners][laid.word_entry])
                if len(some):
                    count(owners[laid.word_entry[some]], laid.hashes(laid.word_start[some], laid.word_length[some]), np.arange(len(some)))
                own, names, _ = laid.tails(start, length)
                cost, own, names = costs.by_part(own, names, len(which))
                rare.add_parts(at, text, own, names, len(which))
                tail = cost[at]
                which, _, at = _unique(laid.heads())
                own, keys = head_keys(which)
                cost, own, names = costs.by_part(own, _names(keys), len(which))
                rare.add_parts(at, text, own, names, len(which))
                bits[:] += np.bincount(text, cost[at] + tail, n)

            for laid, owners in _laid(texts):
                block(laid, owners)
                del laid  # before the next is made
            columns = [batch.column(0), batch.column(2), *map(pa.array, (n_tokens, n_known.astype(np.int64), sums, bits, np.fromiter((len(t) + 1 for t in texts), np.int64, n)))]
            yield pa.RecordBatch.from_arrays([*columns, *rare.lists(n)], ["id", "fold", "n_tokens", "n_known", "sum", "bits", "size", "names", "times"])

    kind = rows.schema[0].dataType.simpleString()
    schema = f"id {kind}, fold int, n_tokens long, n_known long, sum double, bits double, size long, names array<long>, times array<long>"
    told = cut(rows.mapInArrow(settled(run), schema).withColumn("row", F.monotonically_increasing_id()))
    # What is not among the frequent words and strings is looked up by a join. Every string has a cost; a word without a count is unknown.
    x = F.col("x")
    # A name comes once in the rest, so what a task holds of it is even; nothing needs sorting.
    asked = told.select("row", F.explode(F.arrays_zip("names", "times")).alias("x")).select("row", x["names"].alias("name"), x["times"].alias("t"))
    level = F.floor(F.log2("c") * 8)
    rare_words = vocabulary.where(level < bound) if bound else vocabulary.where(F.lit(False))
    others = costs.where(level < rare_bound) if rare_bound else costs.where(F.lit(False))
    rest = rare_words.select(F.col("id").bitwiseXOR(F.lit(word_name(0))).alias("name"), F.lit(WORD).alias("kind"), F.col("c").cast("double").alias("value")).unionByName(
        others.select(F.col("word").alias("name"), F.lit(LONG).alias("kind"), F.col("cost").cast("double").alias("value"))
    )
    of, t, value = F.coalesce("kind", F.lit(WORD)) == WORD, F.col("t"), F.col("value")
    more = asked.join(rest.hint("shuffle_hash"), "name", "left").groupBy("row").agg(
        F.sum(F.when(of, t * F.log10((F.coalesce(value, F.lit(0.0)) + 0.5) / F.lit(float(scale))))).alias("more"),
        F.sum(F.when(of & (value > 0), t)).alias("more_known"),
        F.sum(F.when(~of, t * value)).alias("more_bits"),
    )
    none = F.lit(0.0)
    bits = F.col("bits") + F.coalesce("more_bits", none)
    return told.join(more, "row", "left").select(
        F.col("id").alias(id),
        (F.col("fold") == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("more", none)).alias("base_score"),
        (-bits * float(np.log10(2))).alias("score"),
        (bits / F.col("size")).alias("bits_per_byte"),
    )
