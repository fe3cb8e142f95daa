"""The training-data operators against brute force, on whole small tables and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import bpe, graph, hamming, line_dedup, lm, mixing, mph, pii, quality, queries, sharding, simhash, token_count
from tidemark.llm.common import cut

public_tokenizers = pytest.importorskip("public_tokenizers")
MULTI, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")

LINE = "This line of more than forty characters repeats in many documents"
ODD = [
    None, "", " ", "\n", "\n\n", "one", "one two", "  a\n b  ", "▁x ▁▁ y", "<s> x </s>", "\x00a\x00", "日本語 テスト　x", "a\r\nb\x0bc\x0cd", "😀 emoji don't 's 'll",
    "é" * 300, "x" * 5000, "word " * 30000, "a.b@c.de mail 1.2.3.4 and 4111 1111 1111 1111, +1 (212) 555-1212",
    "\n".join([LINE, "short", LINE]), f"  {LINE.upper()}\t\nown line of the document that is long enough to count", *(f"{LINE}\ndoc {i}" for i in range(5)),
    "iban DE89 3704 0044 0532 0130 00", "a b c d e f g a b c d e z", "Same text of several words here. " * 3, "Same text of several words here. " * 3,
]
#: Columns whose names an operator could want for itself.
CLASHES = "size long, fp long, node string, n_lines string, copies long, _id string, text_crc32 long, id long, key string, n long, component_id long, ids string, _copy long, _row string, kept boolean"


def table(spark, texts, sources=("a", "b", None)):
    rows = [(i if i != 3 else None, t, "en", sources[i % len(sources)], len(t) if t else None, *[1, 2, "x", "y", 3, "z", 4, 5, "k", 6, 7, "w", 8, "v", True]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    more = ["".join(rng.choice("ab \n.'▁é日s1+@-") for _ in range(rng.randrange(60))) for _ in range(300)]
    return cut(table(spark, ODD + more)), ODD + more


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, ["x"]).where("false")


def words(t):
    return (t or "").encode().split()


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_base_figures(odd, empty):
    df, texts = odd
    got = rows_of(quality.judge(df))
    for i, t in enumerate(texts):
        if i == 3:
            continue
        t, r = t or "", got[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    assert quality.keep_good(empty).count() == 0
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert quality.keep_good(df).columns == df.columns
    assert all(r.kept == (not r.base_failed and r.posterior >= quality.THRESHOLD) for r in got.values())


def plain_em(n, failed):
    """Posteriors of patterns by loops, and the log-odds of rules and votes."""
    m = len(quality.RULES)
    votes = {p: [p // 3 ** (m - 1 - j) % 3 for j in range(m)] for p in n}
    prior, ratio = 0.0, [list(quality.START) for _ in range(m)]
    post = lambda p: 1 / (1 + np.exp(-(prior + sum(ratio[j][v] for j, v in enumerate(votes[p])))))
    for _ in range(quality.ROUNDS):
        good = {p: n[p] * post(p) for p in n}
        bad = {p: n[p] - good[p] + failed[p] for p in n}
        g, b = (sum(x.values()) for x in (good, bad))
        share = lambda x, j, v, k, total: (quality.PRIOR[k][v] + sum(x[p] for p in n if votes[p][j] == v)) / (total + sum(quality.PRIOR[k]))
        ratio = [[np.log(share(good, j, v, 0, g) / share(bad, j, v, 1, b)) for v in range(3)] for j in range(m)]
        prior = np.log((g + 1) / (b + 1))
    return {p: post(p) for p in n}, ratio


def drawn_votes(rng, chances):
    """(pattern, base_failed, good) of documents; chances: for each rule, of its votes on good and on bad ones."""
    m, rows = len(quality.RULES), []
    for _ in range(4000):
        good = rng.random() < 0.8
        rows.append((sum(rng.choices((0, 1, 2), chances[j][not good])[0] * 3 ** (m - 1 - j) for j in range(m)), not good and rng.random() < 0.4, good))
    return rows


def test_quality_estimate_matches_plain_em(spark):
    rows = drawn_votes(random.Random(1), [((1, 3, 16), (12, 6, 2))] * len(quality.RULES))
    got = {r.pattern: r.posterior for r in quality.fit(spark.createDataFrame([x[:2] for x in rows], "pattern int, base_failed boolean")).collect()}
    n, failed = Counter(p for p, f, _ in rows if not f), Counter(p for p, f, _ in rows if f)
    want, _ = plain_em(Counter({p: n[p] for p in n | failed}), failed)
    assert got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) < 1e-6


def test_quality_learns_rules_that_are_random_or_wrong(spark):
    right, chance, wrong = ((1, 3, 16), (12, 6, 2)), ((5, 5, 5), (5, 5, 5)), ((12, 6, 2), (1, 3, 16))
    m = len(quality.RULES)
    rows = drawn_votes(random.Random(2), [right] * (m - 2) + [chance, wrong])
    got = {r.pattern: r.posterior for r in quality.fit(spark.createDataFrame([x[:2] for x in rows], "pattern int, base_failed boolean")).collect()}
    assert sum((got[p] >= 0.5) == good for p, _, good in rows) > 0.97 * len(rows)
    n, failed = Counter(p for p, f, _ in rows if not f), Counter(p for p, f, _ in rows if f)
    _, ratio = plain_em(Counter({p: n[p] for p in n | failed}), failed)
    assert max(map(abs, ratio[-2])) < 0.3  # no weight
    assert ratio[-1][0] > 1 and ratio[-1][2] < -1  # its good votes tell against


def brute_simhash(t):
    w = words((t or "").encode().lower().decode())
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, odd, empty):
    df, texts = odd
    near = ["base words of one text that is long enough to be close " * 6 + f"and {i % 7} ends" for i in range(40)]
    df = cut(table(spark, texts + near))
    texts = texts + near
    groups = rows_of(simhash.near_duplicates(df).where("doc_id is not null"))
    ids = [i for i in range(len(texts)) if i != 3]
    fps = [brute_simhash(texts[i]) for i in ids]
    assert [groups[i].fp % 2**64 for i in ids] == fps
    label = brute_components(fps)
    assert [groups[i].component_id for i in ids] == [ids[x] for x in label]
    kept = sorted(r.doc_id for r in simhash.deduplicate(df).collect())
    assert kept == sorted({ids[x] for x in label})
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicate(empty).columns == empty.columns


@pytest.mark.parametrize("rows", [1 << 20, 3000])
def test_simhash_links_in_dense_clusters(rows, monkeypatch):
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(900)}
    fps = np.array(sorted(fps), np.uint64)
    batches = list(simhash._variants([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])]))
    keys = np.concatenate([b.column(0).to_numpy() for b in batches])
    owner = np.concatenate([b.column(1).to_numpy() for b in batches])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    monkeypatch.setattr(simhash, "ROWS", rows)
    out = list(simhash._links(pa.RecordBatch.from_arrays([pa.array(keys[i : i + 997]), pa.array(owner[i : i + 997])], ["key", "fp"]) for i in range(0, len(keys), 997)))
    a, b = (np.concatenate([x.column(i).to_numpy() for x in out]).view(np.uint64) for i in range(2))
    label = brute_components(fps.tolist())
    want = {int(f): int(fps[x]) for f, x in zip(fps, label, strict=True) if f != fps[x]}
    nodes, roots = simhash._forest(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == want


def test_simhash_keys_link_what_whole_balls_link():
    """Keys with a block left out against the plain meeting in the middle: balls of one bit around one, of two around the other."""
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**63))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(250)})
    ones = [1 << i for i in range(64)]
    ball = [0, *ones]
    wide = [*ball, *(a ^ b for k, a in enumerate(ones) for b in ones[:k])]
    assert len(wide) == 2081
    met = defaultdict(set)
    for i, f in enumerate(fps):
        for v in ball:
            met[f ^ v].add(i)
    pairs = {(min(i, j), max(i, j)) for i, f in enumerate(fps) for v in wide for j in met.get(f ^ v, ()) if i != j}
    pairs = {(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 3}
    array = np.array(fps, np.uint64)
    a, b = (np.array([fps[p[k]] for p in sorted(pairs)], np.uint64) for k in range(2))
    label = dict(zip(*(x.tolist() for x in simhash._forest(a, b)), strict=True))
    assert [label.get(f, f) for f in fps] == [fps[x] for x in brute_components(fps)]
    keys = {}
    for block in range(3):  # each linked pair has a key of the left-out kind in common
        rest = simhash._rest(array, block)
        for i, r in enumerate(rest.tolist()):
            for v in (0, *(1 << k for k in range(64 - simhash.BLOCKS[block][1]))):
                keys.setdefault((block, r ^ v), set()).add(i)
    shared = {(i, j) for group in keys.values() for i in group for j in group if i < j}
    assert pairs <= shared


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [64, 96])
def test_top_k(spark, bits):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(260, bits))
    base[100:180] = base[3]  # copies
    base[180:230] = base[5] + 0.3 * rng.normal(size=(50, bits))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000, None), (None, base[0].tolist()), (2000, [1.0] * 10), (40, base[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hamming.top_k(df, bits, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    code = {i: [v[k] > 0 if k < len(v) else False for k in range(bits)] for i, v in rows[:260] + [rows[262]]}
    for q in [i for i in code if i % 20 == 0]:
        want = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:10]
        assert got[q] == want
    assert set(got) == {i for i in code if i % 20 == 0}
    assert hamming.top_k(df.where("false"), bits).count() == 0


def test_sharding(spark, odd, empty, tmp_path):
    df, texts = odd
    rows = sharding.shard(df, 16).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is not None:
            t = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert sharding.shard(empty).count() == 0
    many = spark.range(20000).selectExpr("id doc_id", "repeat('x', cast(id % 50 as int)) text")
    sizes = [r[1] for r in sharding.shard(many, 16).groupBy("shard").sum("size").collect()]
    assert max(sizes) < 1.01 * min(sizes)

    slots = sharding.SlotMap(512, 4)
    weights = {s: 1 + (s * s) % 97 for s in range(512)}
    slots.rebalance(weights)
    old = slots.current
    slots.rebalance(weights, 5)
    moved = {s for s in range(512) if old[s] != slots.current[s]}
    load = [sum(weights[s] for s in range(512) if slots.current[s] == k) for k in range(5)]
    assert max(load) <= 1.02 * min(load)
    assert sum(weights[s] for s in moved) <= 1.1 * sum(weights.values()) / 5


def test_sharding_maps_survive_runs(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = cut(spark.range(20000).selectExpr("id doc_id", "repeat('x', cast(id % 50 as int)) text"))
    first = rows_of(sharding.shard(docs, 16, map_path=path))
    again = rows_of(sharding.shard(docs, 16, map_path=path))
    assert again == first  # nothing to even out
    more = rows_of(sharding.shard(docs, 17, map_path=path))
    assert sharding.SlotMap.load(spark, path).version == 3 and sharding.SlotMap.load(spark, path, 1).shards == 16
    moved = sum(r["size"] for i, r in more.items() if r.shard != first[i].shard)
    total = sum(r["size"] for r in more.values())
    assert 0.9 * total / 17 <= moved <= 1.15 * total / 17
    assert {more[i].shard for i in more if more[i].shard != first[i].shard} <= set(range(17))
    few = sharding.SlotMap(4, 2)  # the last shard may be empty
    few.current, few.version = [0, 0, 0, 0], 1
    few.save(spark, str(tmp_path / "few"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "few")).shards == 2
    assert sharding.SlotMap.load(spark, str(tmp_path / "none")) is None


def test_sharding_places_by_plain_loops(spark, tmp_path):
    """The shards and places once more, from the stored map and sorted lists."""
    rows = [(i, None if i % 11 == 0 else "ab é"[: i % 5] * (i % 40)) for i in range(1500)] + [(7, "copy"), (7, "copy"), (None, "copy"), (None, None)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    path = str(tmp_path / "map")
    got = Counter(tuple(r) for r in sharding.shard(docs, 16, slots=256, map_path=path).collect())
    slot = [r[0] for r in docs.select(sharding.slot_of(docs, 256)).collect()]
    stored = {r.virtual_slot: r.shard for r in spark.read.parquet(f"{path}/version=1").collect()}
    size = lambda t: len((t or "").encode()) + 1
    weights = defaultdict(int)
    for s, (_, t) in zip(slot, rows, strict=True):
        weights[s] += size(t)
    load = Counter()
    for s, w in weights.items():
        load[stored[s]] += w
    assert max(load.values()) - min(load[k] for k in range(16)) <= max(weights.values())
    want, filled = Counter(), Counter()
    for s in range(256):  # virtual slots in order, in each its records in order
        own = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), size(t), i, t) for k, (i, t) in zip(slot, rows, strict=True) if k == s), key=lambda x: x[:4])
        for *_, crc, n, i, _ in own:
            want[(i, n, crc, "bytes", stored[s], filled[stored[s]], None, s)] += 1
            filled[stored[s]] += 1
    assert got == want


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    f = mph.PerfectHash.build(keys)
    assert sorted(f.index(keys).tolist()) == list(range(len(keys)))
    t = mph.LineTable.loads(mph.LineTable.build(keys, ~keys, np.arange(len(keys)), np.arange(len(keys)) - 5).dumps())
    found, n, holder = t.probe(keys, ~keys)
    assert found.all() and (n == np.arange(len(keys))).all() and (holder == n - 5).all()
    assert not t.probe(keys + np.uint64(1), keys)[0].any()
    assert len(t.mph.words) * 64 < 6 * len(keys)
    nothing = mph.PerfectHash.build(keys[:0])
    assert nothing.index(keys[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError):
        mph.PerfectHash.build(np.array([5, 5], np.uint64))


def test_line_dedup_of_repeated_ids(spark):
    """An id that comes five times is one document, as in the SQL."""
    import duckdb

    rows = [(1, LINE)] * 5 + [(i, f"{LINE} and more") for i in (2, 2, 3, 4, 5, 6, 6)] + [(9, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    frame = documents.toPandas()  # noqa: F841  for the SQL
    want = Counter(duckdb.sql(queries.OP5_SQL.replace("FROM documents", "FROM (SELECT DISTINCT * FROM frame)")).fetchall())
    for options in ({}, {"broadcast_bytes": 0, "shard_lines": 1}):
        got = {tuple(r) for r in line_dedup.dedup_lines(documents, digest=True, **options).collect()}
        assert Counter(got) == want


@pytest.mark.parametrize("options", [{}, {"shard_lines": 1}, {"broadcast_bytes": -1}, {"broadcast_bytes": 0, "shard_lines": 1}])
def test_line_dedup(odd, empty, options):
    df, texts = odd
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    ids = [i if i != 3 else None for i in range(len(texts))]
    holders = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    gone = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    assert gone
    got = rows_of(line_dedup.dedup_lines(df, digest=True, **options))
    whole = rows_of(line_dedup.dedup_lines(df, **options))
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = "\n".join(x for x in lines if gone.get(key(x), i) == i)
        r = got[i]
        assert (r.n_lines, r.kept_sha256) == (len(lines), hashlib.sha256(kept.encode()).hexdigest())
        assert r.n_dropped == sum(gone.get(key(x), i) != i for x in lines)
        assert whole[i].text == (None if t is None else kept)
    assert line_dedup.dedup_lines(empty).count() == 0


def bpe_library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(MULTI, "rb") as f:
        code = bpe.ByteBPE(f.read(), public_tokenizers.PATTERN)
    return code, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.ranks, special_tokens={})


@pytest.mark.parametrize("block_bytes", [1, 2000, bpe.BLOCK])
def test_bpe(odd, empty, block_bytes):
    _, library = bpe_library()
    df, texts = odd
    encoded = cut(bpe.encode(df, MULTI, public_tokenizers.PATTERN, block_bytes=block_bytes))
    for r in encoded.collect():
        t = texts[r.doc_id if r.doc_id is not None else 3] or ""
        ids = library.encode_ordinary(t)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for r in bpe.decode(encoded, MULTI).collect():
        assert r.decoded == (texts[r.doc_id if r.doc_id is not None else 3] or "")
    assert bpe.encode(empty, MULTI, public_tokenizers.PATTERN).count() == 0


def test_bpe_splits_as_the_pattern_says(odd):
    import regex

    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    texts = ["".join(every[:0xF800]), *("".join(rng.choices(every, k=300)) for _ in range(300)), *("".join(rng.choices(every[:0x250] + list(" '\n\t s't"), k=300)) for _ in range(300))]
    for pattern in (public_tokenizers.PATTERN, r"\p{Lu}+|[\p{L}--a]|.", r"\d+|\D", r"a{2}|."):
        want = regex.compile(pattern).findall
        find = bpe.splitter(pattern)
        assert all(find(t) == want(t) for t in [*texts, *(t for t in odd[1] if t)])
    assert bpe.splitter(public_tokenizers.PATTERN).__name__ == "find"  # the faster one is there


def test_bpe_answers_are_told_by_their_bytes():
    code, library = bpe_library()
    words = ["unbelievable", "zzqqxx", "Überraschungen", "日本語テスト", "a"]
    ids = {w: library.encode_ordinary(w) for w in words}
    right = [np.array(ids[w], code.width).tobytes() for w in words if w.encode() not in code.ranks]
    for given in (right, right[::-1], right[:1], []):  # in order, in another, or missing
        table = bpe.Answers(code, given)
        assert [table[w] for w in words] == [(",".join(map(str, ids[w])), w.encode()) for w in words]


def test_bpe_replays_a_word_once(spark, tmp_path, monkeypatch):
    words = [f"word{i}zq" for i in range(300)]
    spark.createDataFrame([(i, " ".join(words)) for i in range(40)], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    docs = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "d"))
    path = str(tmp_path / "answers")
    monkeypatch.setattr(bpe, "scratch", lambda s, name: path)
    got = bpe.encode(docs, MULTI, public_tokenizers.PATTERN).select("ids_sha256").distinct().count()
    answers = spark.read.parquet(path)
    assert got == 1 and answers.count() == answers.select("task", "place").distinct().count()
    assert answers.groupBy("task").count().agg({"count": "max"}).first()[0] <= 2 * len(words)  # each word once a task, with and without the space


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        over = [s for s in order if s not in capped and left * w[s] / free > cap * sizes[s] + 1e-9]
        if not over:
            return {s: cap * sizes[s] if s in capped else left * w[s] / free for s in order}
        capped |= set(over)


def test_mixing(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), s) for i, s in enumerate(rng.choices(["a", "b", "c", "d", "", None], (60, 20, 10, 2, 5, 3), k=3000))]
    rows += [(5000, None, "a"), (5001, "", "b"), (None, "x y", "c"), (5002, "x", "wordless ok"), (5003, None, "silent")]
    df = cut(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = cut(mixing.copies(df)).collect()
    assert sorted(got, key=str) == sorted(mixing.copies(df).collect(), key=str)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(0.03 * want[s], 200) for s in sizes)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.copies(odd[0]).count() == len(odd[1])
    whole = mixing.mix(odd[0])
    assert whole.columns == odd[0].columns and {r["_copy"] for r in whole.collect()} == {8}
    several = spark.createDataFrame([(i, "w " * (i % 9), f"host{i % 500}") for i in range(2000)], "doc_id long, text string, source string")
    sums = Counter()
    for i in range(2000):
        sums[f"host{i % 500}"] += i % 9
    targets = brute_targets(sums)
    for r in mixing.copies(several).collect():
        assert r.target == pytest.approx(targets[f"host{r.doc_id % 500}"], abs=1e-6)


def brute_pii(t):
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, t) if ok(m.group())] for k, (p, ok) in kinds.items()}


def test_pii(spark, odd, empty):
    rng = random.Random(3)
    texts = [
        "a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.255", "4111-1111-1111-1111 4111  1111 1111 1111 5500005555555559",
        "+1 (212) 555-1212+44 20 7946 0958", "é😀 4111111111111111 a@b.co", "a" * 50000, "1" * 20000, "a.a" * 5000 + "@" + "b.c" * 5000, "+1 234 5678 " * 2000, None, "",
        *("".join(rng.choice("ab1 .@+-4()_%9\né") for _ in range(rng.randrange(80))) for _ in range(500)),
        *("".join(rng.choice("0123456789 -.+") for _ in range(rng.randrange(120))) for _ in range(500)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        for kind, spans in brute_pii(texts[r.doc_id] or "").items():
            assert [(s.start, s.end) for s in r[kind]] == spans, (kind, texts[r.doc_id])
    more = ["iban DE89 3704 0044 0532 0130 00.", "iban DE88 3704 0044 0532 0130 00.", "my ssn 536-90-4399", "part 536-90-4399", 'token = "' + "0a" * 20 + '"', "0a" * 20]
    got = pii.find(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(len(r.iban), len(r.ssn), len(r.secret)) for r in got] == [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert (got[0].iban[0].start, got[0].iban[0].end) == (5, 32)
    clean = pii.redact(spark.createDataFrame([(1, "call +1 (212) 555-1212 or a@b.co."), (2, None)], "doc_id long, text string"))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["call [PHONE] or [EMAIL].", None]
    assert pii.find(empty).count() == 0 and pii.find(odd[0]).count() == len(odd[1])


def test_pii_ibans_end_with_their_length(spark):
    texts = {
        "iban AT61 1904 3002 3457 3201 BIC OPSKATWW": ["AT61 1904 3002 3457 3201"],
        "iban BE68 5390 0754 7034 12 March": ["BE68 5390 0754 7034"],
        "accounts BE68539007547034 BE71096123456769": ["BE68539007547034", "BE71096123456769"],
        "iban ES91 2100 0418 4502 0005 1332 PAID": ["ES91 2100 0418 4502 0005 1332"],
        "iban DE89 3704 0044 0532 0130 00 EUR": ["DE89 3704 0044 0532 0130 00"],
        "iban NO9386011117947 and NL91 ABNA 0417 1643 00.": ["NO9386011117947", "NL91 ABNA 0417 1643 00"],
        "bank ID12 2024 0001 AT611904300234573201": ["AT611904300234573201"],
        "iban AT62 1904 3002 3457 3201 or AT61 1904 3002 3457 32019": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(pii.find(df))
    for i, (text, want) in enumerate(texts.items()):
        assert [text[s.start : s.end] for s in got[i].iban] == want
    hidden = rows_of(pii.redact(df))
    assert hidden[2].text == "accounts [IBAN] [IBAN]"


def test_lm(spark, odd, empty):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioustnr") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randrange(5, 120))) for _ in range(400)]
    texts += ["", None, "New words only here", "xqzj wvkq " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(lm.score(df))
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    tokens = [words((t or "").lower()) for t in texts]
    counts = Counter(w for i, ws in enumerate(tokens) if i not in held for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    for i, ws in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i in held, len(ws) + 1, n)
        assert r.n_known == sum(counts[w] > 0 for w in [*ws, None])
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), abs=1e-6)
        assert r.score < 0
    size = sum(len((texts[i] or "").encode()) + 1 for i in held)
    per_byte = -sum(got[i].score for i in held) / log10(2) / size
    order0 = Counter(b for i, t in enumerate(texts) if i not in held for b in (t or "").encode())
    flat = -sum(log10((order0[b] + 0.5) / (sum(order0.values()) + 128)) for i in held for b in (texts[i] or "").encode()) / log10(2) / size
    assert per_byte < 0.8 * flat  # held-out accuracy
    assert got[len(texts) - 1].bits_per_byte > 1.5 * per_byte or len(texts) - 1 not in held
    assert lm.score(empty).count() == 0 and lm.score(odd[0]).count() == len(odd[1])


def test_lm_rare_words_are_joined(spark, monkeypatch):
    texts = [f"common words w{i} w{i % 50} x{i % 3}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rows_of(lm.score(df))
    monkeypatch.setattr(lm, "frequent", lambda counts, most=8, real=lm.frequent: real(counts, most))
    got = rows_of(lm.score(df))
    for i, r in want.items():
        assert got[i].base_score == pytest.approx(r.base_score, abs=1e-9) and got[i].n_known == r.n_known


def test_token_count(odd, empty):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=PIECES)
    df, texts = odd
    for r in token_count.count_tokens(df, PIECES).collect():
        t = texts[r.doc_id if r.doc_id is not None else 3] or ""
        n = len(library.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096), t[:50]
    assert token_count.count_tokens(empty, PIECES).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioustnrlm") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    good = [". ".join(" ".join(rng.choices(vocabulary, k=9)) for _ in range(12)) + "." for _ in range(60)]
    texts = good + [good[0], good[1] + " end"] + ["BUY!! NOW!! CHEAP!! " * 20, "$$$ ### &&& *** a b c " * 10, "few words"] + [f"{LINE}\n{g}" for g in good[:6]]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert k == 4 or docs.columns == columns, name
    assert counts[0] == set(range(len(texts))) - {62, 63, 64}
    assert counts[1] == counts[0]
    assert counts[2] <= counts[1] and 60 not in counts[2] and set(range(6, 60)) <= counts[2]
    lines = spark.read.parquet(str(tmp_path / "s1"))
    assert [r.doc_id for r in lines.where(f"text like '{LINE}%'").collect()] == [70]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r.ids_sha256 for r in docs.collect())


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.queries()) | {"pipeline"} <= names
    assert set(e.oracle_sql()) <= names
