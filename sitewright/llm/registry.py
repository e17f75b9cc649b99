"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, neardup, pii, quality, sharding, substring, toxicity, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents")).drop("node")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, translate(
    to_base(('0x' || substr(h, 1, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(h, 6, 5))::BIGINT, 32, 4) ||
    to_base(('0x' || substr(h, 11, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(h, 16, 5))::BIGINT, 32, 4) ||
    to_base(('0x' || substr(h, 21, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(h, 26, 5))::BIGINT, 32, 4) ||
    to_base(('0x' || substr(h, 31, 5))::BIGINT, 32, 4) || to_base(('0x' || substr(h, 36, 5))::BIGINT, 32, 4),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
), g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
    sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP8_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT r, list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' ')) AS s FROM w WHERE len(ws) >= 35)
), d AS (
  SELECT s FROM g GROUP BY s HAVING count(*) > 1
), h AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM g SEMI JOIN d USING (s)
), k AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN h USING (r, i) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)
"""


def queries() -> dict[str, Query]:
    return {"op1_warc": op1_warc, "op2_sharding": op2_sharding, "op3_pii": op3_pii, "op4_quality": op4_quality, "op5_bpe": op5_bpe, "op6_exact_dedup": op6_exact_dedup, "op7_decontaminate": op7_decontaminate, "op8_substring": op8_substring, "op9_neardup": op9_neardup, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op8_substring": OP8_SQL}
