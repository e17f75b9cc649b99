"""Queries of extraction, chunking, retrieval and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P, retrieval as R
from ..streaming import watch as W
from .base import table
from .scalar_queries import LINKS_SQL


def _headed(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("url"), F.concat(F.lit("# "), "lang", F.lit("\n\n"), "text").alias("markdown"))


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text")
    size = docs.select(F.size(R.terms(F.col("text"))).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    queries = table(s, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    sparse = R.bm25(R.postings(docs, "doc_id", "text", queries), queries, size["n"], size["mean"])
    dense = R.dense(R.hashed_vectors(docs, "doc_id", "text"), R.hashed_vectors(queries, "qid", "q").withColumnRenamed("id", "qid"))
    return R.top(R.fuse(sparse, dense), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


QUERIES = {
    "html_extract": lambda s, d: P.extract_pages(table(s, d, "pages"), main="article").select("url", "status", "title", F.length("markdown").alias("n")),
    "page_titles": lambda s, d: P.extract_pages(table(s, d, "pages"), main="article").select("url", "status", "title"),
    "page_links": lambda s, d: P.extract_pages(table(s, d, "pages"), drop=("script", "style")).select("url", F.explode("links").alias("l")).select("url", F.col("l.url").alias("dst_url"), F.col("l.anchor_text").alias("anchor_text")),
    "src_pages": lambda s, d: P.extract_pages(table(s, d, "pages")).groupBy("status").agg(F.count("*").alias("n")),
    "heading_sections": lambda s, d: P.chunk_pages(_headed(s, d)).select("url", "section", "level").distinct(),
    "chunk_count_by_doc": lambda s, d: P.chunk_pages(_headed(s, d)).groupBy("url").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")),
    "hybrid_search": _hybrid,
    "session_counts": lambda s, d: W.session_counts(table(s, d, "events"), "user_id", "ts"),
    "rate_limit": lambda s, d: W.rate_limit(table(s, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")), "user_id", "ms", most=2, window_ms=86_400_000).groupBy("user_id", "allowed").agg(F.count("*").alias("n")),
}

SHOWN = "trim(regexp_replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"

ORACLE = {
    "page_titles": f"SELECT url, 'indexed' AS status, {SHOWN.format(x="regexp_extract(html, '<h1>([^<]*)', 1)")} AS title FROM pages",
    "page_links": f"SELECT url, dst_url, anchor_text FROM (SELECT DISTINCT page_id, p.url, dst_url, {SHOWN.format(x='anchor_text')} AS anchor_text FROM ({LINKS_SQL}) l JOIN pages p USING (page_id))",
    "src_pages": "SELECT 'indexed' AS status, count(*) AS n FROM pages",
    "heading_sections": "SELECT doc_id::VARCHAR AS url, lang AS section, 1 AS level FROM documents",
    "rate_limit": """WITH e AS (SELECT user_id, list({'opened': epoch_ms(ts), 'n': 1, 'allowed': 1} ORDER BY ts) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, len(l) AS total, list_reduce(l, lambda a, b: CASE WHEN b.opened >= a.opened + 86400000 THEN {'opened': b.opened, 'n': 1, 'allowed': a.allowed + 1} ELSE {'opened': a.opened, 'n': a.n + 1, 'allowed': a.allowed + CASE WHEN a.n < 2 THEN 1 ELSE 0 END} END).allowed AS k FROM e)
SELECT user_id, true AS allowed, k::BIGINT AS n FROM f UNION ALL SELECT user_id, false, (total - k)::BIGINT FROM f WHERE total > k""",
    "session_counts": "WITH e AS (SELECT user_id, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000 THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM e GROUP BY user_id",
}
