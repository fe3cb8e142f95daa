"""The registered queries against brute force, on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import pytest

from tidemark.llm import queries

from .test_operators import MULTI, PIECES, brute_components, brute_pii, brute_simhash, brute_targets, public_tokenizers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    found = queries.queries()[name](spark, SF).collect()
    out = {r.doc_id: r for r in found}
    assert len(out) == len(found)
    return out


def test_op1(spark, texts):
    got = rows(spark, "op1_quality")
    assert set(got) == set(texts)
    for i, t in texts.items():
        w, r = WORD.findall(t or ""), got[i]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = len({k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w)) and not (r.base_failed and r.kept)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(got[i].kept for i in good) >= 0.95 * len(good) and sum(got[i].kept for i in bad) <= 0.1 * len(bad)


def test_op2(spark, texts):
    got = rows(spark, "op2_simhash")
    ids = sorted(texts)
    fps = [brute_simhash(texts[i]) for i in ids]
    label = brute_components(fps)
    assert [(got[i].fingerprint, got[i].component_id) for i in ids] == [(f"{f:016x}", ids[x]) for f, x in zip(fps, label, strict=True)]


def test_op4(spark, texts):
    got = rows(spark, "op4_sharding")
    places, sizes = defaultdict(list), Counter()
    for i, t in texts.items():
        data, r = (t or "").encode(), got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 16
        places[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    largest = max(len((t or "").encode()) + 1 for t in texts.values())
    assert max(sizes.values()) - min(sizes[k] for k in range(16)) <= largest


def test_op6(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(MULTI), special_tokens={})
    got = rows(spark, "op6_bpe")
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_op7(spark, texts):
    got = rows(spark, "op7_mixing")
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    sizes = Counter()
    for i, t in texts.items():
        sizes[source[i]] += len(WORD.findall(t or ""))
    want, taken, largest = brute_targets(sizes), Counter(), Counter()
    for i, t in texts.items():
        r, s = got[i], source[i]
        assert r["size"] == len(WORD.findall(t or "")) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= 1.5 * largest[s] for s in sizes)


def test_op8(spark, texts):
    got = rows(spark, "op8_pii")
    for i, t in texts.items():
        spans = brute_pii(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, x in spans.items() for a, b in x)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans.values()]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans == listed or r.spans.startswith(listed + ",") or not listed
        assert r.n_all == len([x for x in r.spans.split(",") if x]) and (r.top_score is None) == (r.n_all == 0)
        more = r.spans.split(",")[len([x for x in listed.split(",") if x]) :]
        assert all(re.fullmatch(r"(iban|ssn|secret):\d+:\d+", x) for x in more if x)


def test_op9(spark, texts):
    got = rows(spark, "op9_context_mixing")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-6)
    order0 = Counter(b for i, t in texts.items() if i not in held for b in (t or "").lower().encode())
    flat = -sum(log10((order0[b] + 0.5) / (order0.total() + 128)) for i in held for b in (texts[i] or "").lower().encode())
    assert -sum(got[i].score for i in held) < 0.8 * flat  # where it has not learned


def test_op10(spark, texts):
    sp = pytest.importorskip("sentencepiece")
    library = sp.SentencePieceProcessor(model_file=PIECES)
    got = rows(spark, "op10_token_count")
    for i, t in texts.items():
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
