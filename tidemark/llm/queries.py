"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hamming, line_dedup, lm, mixing, pii, quality, sharding, simhash, token_count
from .common import documents, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    bits = vectors.agg(F.max(F.size("embedding"))).first()[0] or 64  # the whole vectors
    found = hamming.top_k(vectors, bits=bits)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP3_SQL = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(list_zip(q.code, x.code), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM codes q JOIN codes x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), digest=True)


#: A-Z in lower case, and the white space that is stripped, for any SQL engine.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM parts),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), {_LOWER}) AS key FROM lines),
often AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT keyed.*, often.key IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         floor(('0x' || substr(md5('band7|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0 * 64) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(log2(size + 1) * 8), h, size, doc_id NULLS FIRST) AS place FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1]::DOUBLE AS w, 3.0 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, (cap / w, rank)) FROM l WHERE level <= cap / w))::DOUBLE AS target,
         ('0x' || substr(md5('offset7|' || coalesce(source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
p AS (SELECT r.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, least(floor(place * rate + u) - floor((place - 1) * rate + u), 3)::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM n
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in pii.KINDS if k.base]
    return pii.find(documents(spark, sf_dir)).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(pii.listed(F.concat(*base)), 256).alias("base_sha256"),
        pii.listed(F.concat(*(k.name for k in pii.KINDS))).alias("spans"),
        sum((F.size(k.name) for k in pii.KINDS[1:]), F.size(pii.KINDS[0].name)).cast("long").alias("n_all"),
        F.array_max(F.transform(F.concat(*(k.name for k in pii.KINDS)), lambda s: s["score"])).alias("top_score"),
    )


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_simhash": op2_simhash,
        "op3_hamming_top_k": op3_hamming_top_k,
        "op4_sharding": op4_sharding,
        "op5_line_dedup": op5_line_dedup,
        "op6_bpe": op6_bpe,
        "op7_mixing": op7_mixing,
        "op8_pii": op8_pii,
        "op9_context_mixing": op9_context_mixing,
        "op10_token_count": op10_token_count,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_hamming_top_k": OP3_SQL,
        "op5_line_dedup": OP5_SQL,
        "op7_mixing": OP7_SQL,
    }
