"""The language model against counts of plain bytes."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from tidemark.llm import lm

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randrange(1, 9))) for _ in range(150)]
TEXTS = [RNG.choice([" ", "\n", "  "]).join(RNG.choices(WORDS, k=RNG.randrange(30))) for _ in range(150)]
TEXTS += ["", "\x00\x01 \x02\x03", "x" * 200 + " y", "ab" * 150, " lead and trail \n", "é", "a b c", "x" * 64, "x" * 63, "y" * 32, "y" * 31, "y" * 33]


def segments(data: bytes):
    """(position in the text with its end, bytes before it in the segment) by plain loops."""
    data, start = data + b"\xff", 0
    for at in range(len(data)):
        if at - start == lm.LONGEST:
            start = at
        yield at, data[start:at]
        if data[at : at + 1].isspace() and data[at] < 128:
            start = at + 1


def strings(data: bytes):
    """Per byte: the byte, the four bytes before and the segment so far (None for its first four bytes)."""
    whole = b"\xff" * 4 + data + b"\xff"
    for at, before in segments(data):
        yield whole[at + 4], whole[at : at + 4], before if len(before) >= 4 else None


def test_segments_words_and_strings(monkeypatch):
    texts = [t.encode().lower() for t in TEXTS]
    laid = lm.Laid([(b"\xff" * 4, t, True) for t in texts])
    assert laid.length.sum() == sum(len(t) + 1 for t in texts) and laid.length.max() == lm.LONGEST
    has = laid.word_length > 0
    got = laid.hashes(laid.word_start[has], laid.word_length[has]).tolist()
    assert got == [lm.word_hash(w) for t in texts for w in t.split()]
    key = lambda byte, before: int.from_bytes(before + bytes([byte]))
    want = Counter(key(b, four) for t in texts for b, four, _ in strings(t))

    def keys(laid):
        _, heads = lm.head_keys(laid.heads())
        _, _, tails = laid.tails(laid.start, laid.length)
        return Counter(heads.tolist()) + Counter(tails.tolist())

    assert keys(laid) == want
    longer = defaultdict(set)
    own, hashes, _ = laid.tails(laid.start, laid.length)
    for h, (b, s) in zip(hashes.tolist(), [(b, s) for t in texts for b, _, s in strings(t) if s is not None], strict=True):
        longer[h].add((b, s))
    assert all(len(x) == 1 for x in longer.values()) and len(longer) == len(set.union(*longer.values()))

    monkeypatch.setattr(lm, "PIECE", 64)  # pieces give the same strings
    monkeypatch.setattr(lm, "BLOCK", 300)
    total, words, torn = Counter(), [], 0
    for laid, owners in lm._laid(texts):
        total += keys(laid)
        assert len(owners) == laid.entry.max() + 1
    assert total == want
    assert [lm._torn(t) for t in texts] == [max(map(len, t.split()), default=0) > 63 and len(t) > 64 for t in texts]
    long = b"word" * 100
    assert lm.word_hash(long) != lm.word_hash(long[:-1])
    monkeypatch.setattr(lm, "PIECE", 1 << 20)
    assert lm.word_hash(long) == lm.Laid([(b"\xff" * 4, long, True)]).hashes(np.array([4]), np.array([400]))[0]


def test_states_of_contexts():
    rng = np.random.default_rng(3)
    own = np.unique(rng.integers(1, 1 << 56, 200_000, dtype=np.uint64))  # each seen once, in a context of its own
    once = lm.context_states(own, np.ones(len(own)))
    assert (once >> 8 == 2).all()
    assert (lm.context_states(own, np.ones(len(own)), np.ones(len(own))) == lm.UNSEEN).all()  # nothing is left without its own
    assert lm.context_states(own[:0], np.zeros(0)).shape == (0, 8)


def brute(texts, held, weights, maps):
    """Bits of each text by counts of bytes as they are."""
    n = defaultdict(lambda: [0, 0])

    def contexts(byte, four, segment, i):
        node = (i, byte >> (8 - i))
        out = [(k, four[4 - k :], node) for k in range(5)]
        return [*out, ("word", segment, node) if segment is not None else out[4]]

    for j, t in enumerate(texts):
        if j not in held:
            for byte, four, segment in strings(t):
                for i in range(8):
                    for c in set(contexts(byte, four, segment, i)):
                        n[c][byte >> (7 - i) & 1] += 1

    def bits(byte, four, segment):
        total = 0.0
        for i in range(8):
            n0, n1 = np.array([n[c] for c in contexts(byte, four, segment, i)], float).T
            stretch, cell = lm._inputs(lm._packed(n0, n1)[:, None])
            z = (weights[cell] * stretch).sum(axis=0)
            node = np.array([1 << i | byte >> (8 - i)])
            p = np.clip((lm._squash(z) + maps[lm._refined(node, z)]) / 2, 1e-5, 1 - 1e-5)[0]
            total -= np.log2(p if byte >> (7 - i) & 1 else 1 - p)
        return total

    known: dict = {}
    return [sum(known.setdefault(s, None) or known.__setitem__(s, bits(*s)) or known[s] for s in strings(t)) for t in texts]


@pytest.mark.parametrize(("common", "keys"), [(1 << 20, 1 << 19), (40, 0)])  # all strings and states sent, or joined
def test_scores_match_brute_force(spark, monkeypatch, common, keys):
    rng = np.random.default_rng(1)
    weights = rng.uniform(0.1, 0.5, lm.GATES * lm.INPUTS * lm.SURE).astype(np.float32)
    maps = np.clip(lm.FLAT_MAP + rng.normal(0, 0.02, len(lm.FLAT_MAP)), 0.001, 0.999)
    monkeypatch.setattr(lm, "learn_weights", lambda strings, sent: weights)
    monkeypatch.setattr(lm, "learn_maps", lambda strings, sent, w: maps)
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "KEYS", keys)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    held = {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 5 == 1}
    want = brute([t.encode().lower() for t in TEXTS], held, weights, maps)
    got = {r.doc_id: r for r in lm.score(df).collect()}
    for i, t in enumerate(TEXTS):
        assert -got[i].score / log10(2) == pytest.approx(want[i], rel=1e-4)
        assert got[i].bits_per_byte == pytest.approx(want[i] / (len(t.encode()) + 1), rel=1e-4)


def test_learned_weights_beat_the_start(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select(df.text.alias("_text"), lm.fold(df.doc_id).alias("_fold"))
    strings = lm.Strings(lm.string_counts(rows))
    sent, whole = strings.sent(1), strings.sent(0)
    weights = lm.learn_weights(strings, sent)
    maps = lm.learn_maps(strings, sent, weights)
    every = {r.word: r.cost for r in lm.string_costs(strings, whole, weights, maps).collect()}
    flat = {r.word: r.cost for r in lm.string_costs(strings, whole, np.full(len(weights), 0.3, np.float32), lm.FLAT_MAP).collect()}
    held = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 == 1]
    laid = lm.Laid([(b"\xff" * 4, t, True) for t in held])
    names = np.concatenate((lm._names(lm.head_keys(laid.heads())[1]), laid.tails(laid.start, laid.length)[1])).view(np.int64).tolist()
    assert sum(every[x] for x in names) < 0.97 * sum(flat[x] for x in names)


def test_costs_are_probabilities():
    rng = np.random.default_rng(5)
    table = rng.integers(0, 256, lm.FIRST[lm.DENSE], dtype=np.uint16) | np.uint16(3 << 8)
    keys = np.uint64(0x61626364 << 8) | np.arange(256, dtype=np.uint64)
    states = lm.context_states(keys, rng.integers(0, 9, 256))[:, None].repeat(2, 1)
    steps = lm.Known(table, keys, states).of(np.zeros(256, np.int32), keys, states[:0, 0], None)
    bits = lm.string_bits(steps, rng.uniform(0, 0.5, lm.GATES * lm.INPUTS * lm.SURE).astype(np.float32), lm.FLAT_MAP)
    assert (2.0**-bits).sum() == pytest.approx(1.0, abs=1e-6)


def test_small_partitions_share_tasks(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(40).write.parquet(str(tmp_path / "d"))
    docs = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "d"))
    assert lm.dealt(docs).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
