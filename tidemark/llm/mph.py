"""Minimal perfect hashing of 64-bit keys by cascaded collision-free bits.

Each level hashes the keys that are left into a bit array of about GAMMA bits a
key; keys that are alone on their bit are settled there, the others go on. A
key's index is the rank of its bit over all levels. About three bits a key.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA, LEVELS = 2.0, 60
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    x ^= x >> np.uint64(31)
    return (x % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Index from 0 to n - 1 of each of n distinct keys; other keys get any index or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes // 64)))  # first word of a level
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words = keys, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            bits = 64 * max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = _place(left, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys repeat")
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _place(keys[open_], level, bits)
            word = self.starts[level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            own = self.words[word]
            hit = (own >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.ranks[word[hit]] + below[hit]
            open_ = open_[~hit]
        return out


class LineTable:
    """Compact arrays over one shard of line hashes: fingerprint, count and holder by perfect-hash index."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.mph, self.prints, self.counts, self.holders = mph, prints, counts, holders

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> LineTable:
        mph = PerfectHash.build(lo)
        at = mph.index(lo)
        arrays = [np.empty(len(lo), d) for d in (np.uint64, np.uint32, np.int64)]
        for array, values in zip(arrays, (hi, np.minimum(counts, 2**32 - 1), holders), strict=True):
            array[at] = values
        return cls(mph, *arrays)

    def dumps(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, sizes=self.mph.sizes, words=self.mph.words, prints=self.prints, counts=self.counts, holders=self.holders)
        return f.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> LineTable:
        x = np.load(io.BytesIO(data))
        return cls(PerfectHash(x["sizes"], x["words"]), x["prints"], x["counts"], x["holders"])

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each line is in the table, its count and its holder."""
        at = self.mph.index(lo)
        found = at >= 0
        at = np.where(found, at, 0)
        if not len(self.prints):
            none = np.zeros(len(lo), np.int64)
            return none.astype(bool), none, none
        found &= self.prints[at] == hi
        return found, self.counts[at].astype(np.int64), self.holders[at]
