"""Queries of whole searches, and of the lists for language models. The questions are the benchmark items whose id divides
by 20; pages are those with a url of their own, sections their paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import diff, links as L, retrieval as R, search as H
from ..sources import readers
from .base import DEPTH_SQL, PAGES_SQL, site_pages, table
from .relational_queries import E_, H_, TITLE, _edges, _hits
from .scalar_queries import BLANK, WEIGHT_SQL, WEIGHTS


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """The pages as an index has them."""
    pages = diff.dedupe_first(site_pages(s, d), "url", "page_id")
    pages = L.with_incoming(pages, _edges(s, d)).withColumn("depth", S.url_depth(F.col("url")))
    return pages.select("url", "title", "html", "incoming_links", "depth", F.lit(None).cast("string").alias("description"), F.slice(S.segments(F.col("url")), 1, 1).alias("tags"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))


def _sections(records: DataFrame) -> DataFrame:
    parts = F.posexplode(F.expr("regexp_extract_all(html, '<p>([^<]*)', 1)")).alias("pos", "text")
    rows = records.select("url", "title", "incoming_links", "depth", "tags", parts)
    return rows.withColumn("chunk_key", F.concat_ws("#", "url", "pos")).withColumn("section", F.concat(F.lit("p"), "pos")).withColumn("path", F.array("section"))


def _scored(texts: DataFrame, key: str, questions: DataFrame) -> DataFrame:
    """qid, key, score by BM25, to six digits so that equal texts are ties."""
    size = texts.select(F.size(R.terms(F.col("text"))).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    asked = questions.select("qid", F.col("query").alias("q"))
    scores = R.bm25(R.postings(texts, key, "text", asked), asked, size["n"], size["mean"] or 1.0)
    return scores.select("qid", F.col("id").alias(key), F.round("score", 6).alias("score"))


def _search_pages(s: SparkSession, d: str) -> DataFrame:
    records, questions, request = _records(s, d), _questions(s, d), H.Request(top_k=10, sub_results=3)
    pages = H.ranked(_scored(records, "url", questions), records.drop("text", "html"), questions, request, weight=P.weight_for(F.col("url"), WEIGHTS))
    sections = _sections(records)
    shown = H.results(pages, _scored(sections, "chunk_key", questions), sections, request)
    return shown.select("qid", F.col("rank").cast("long").alias("rank"), "url", "section_title", "score", F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_sections"))


def _search_chunks(s: SparkSession, d: str) -> DataFrame:
    questions, request = _questions(s, d), H.Request(top_k=10, path_prefix="en", tags=("en",), by="chunk")
    sections = _sections(_records(s, d))
    found = H.ranked(_scored(sections, "chunk_key", questions), sections.drop("text", "path"), questions, request)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "chunk_key", F.round("final_score", 6).alias("score"))


def _listed(s: SparkSession, d: str) -> DataFrame:
    pages = diff.dedupe_first(_hits(s, d), "url", "page_id")
    return pages.withColumn("description", F.when(F.col("page_id") % 2 == 0, F.lit("about it"))).withColumn("markdown", F.concat(F.lit("\n"), "title", F.lit("  ")))


QUERIES = {
    "search_pages": _search_pages,
    "search_chunks": _search_chunks,
    "llms_txt": lambda s, d: readers.llms_txt(_listed(s, d), "Site", "All of it", "https://x.y/"),
    "llms_full": lambda s, d: readers.llms_full(_listed(s, d), "Site"),
}

TERMS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
QUESTIONS = "SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id % 20 = 0"
RECORDS = f"""SELECT p.url, title, html, {DEPTH_SQL.replace('url', 'p.url')} AS depth, coalesce(n, 0) AS incoming_links, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS nth FROM ({PAGES_SQL})) p LEFT JOIN (SELECT dst_url AS url, count(DISTINCT src_url) AS n FROM {E_} GROUP BY dst_url) l ON l.url = p.url WHERE nth = 1"""
SECTIONS = "SELECT *, url || '#' || pos AS chunk_key FROM (SELECT url, title, depth, incoming_links, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM records))"


def _bm25_sql(rows: str, key: str, name: str) -> str:
    """Common table expressions that end in `name`: qid, key, score."""
    return f"""{name}_t AS (SELECT {key}, {TERMS.format(x='text')} AS ts FROM {rows}), {name}_n AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM {name}_t),
{name}_f AS (SELECT {key}, size, term, count(*) AS tf FROM (SELECT {key}, len(ts) AS size, unnest(ts) AS term FROM {name}_t) GROUP BY ALL), {name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name} AS (SELECT qid, {key}, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score
FROM (SELECT DISTINCT qid, unnest({TERMS.format(x='query')}) AS term FROM questions) JOIN {name}_f USING (term) JOIN {name}_d USING (term), {name}_n GROUP BY qid, {key})"""


ASKED = BLANK.format(x="regexp_replace(lower(query), '[^a-z0-9\\s]', '', 'g')")
BOOSTED = f"score + ln(1 + incoming_links::DOUBLE) * 0.05::DOUBLE + 0.03::DOUBLE / (1 + depth) + CASE WHEN {TITLE} <> '' AND {ASKED} <> '' AND (contains({TITLE}, {ASKED}) OR contains({ASKED}, {TITLE})) THEN 0.15::DOUBLE ELSE 0::DOUBLE END"

ORACLE = {
    "search_pages": f"""WITH questions AS ({QUESTIONS}), records AS ({RECORDS}), sections AS ({SECTIONS}), {_bm25_sql('records', 'url', 'page_scores')}, {_bm25_sql('sections', 'chunk_key', 'chunk_scores')},
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, url) AS nth FROM page_scores), h AS (SELECT *, {WEIGHT_SQL} AS w FROM c JOIN records USING (url) JOIN questions USING (qid) WHERE nth <= 20),
f AS (SELECT qid, url, ({BOOSTED}) * w AS final FROM h WHERE w <> 0), t AS (SELECT * FROM (SELECT *, max(final) OVER (PARTITION BY qid) AS top FROM f) WHERE top <= 0 OR final >= top * 0.7::DOUBLE),
g AS (SELECT *, lag(final) OVER (PARTITION BY qid ORDER BY final DESC, url) AS before, row_number() OVER (PARTITION BY qid ORDER BY final DESC, url) AS rank FROM t),
k AS (SELECT *, max(CASE WHEN before > 0 AND (before - final) / before >= 0.4::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS cut FROM g),
b AS (SELECT qid, s.url, 'p' || s.pos AS section, row_number() OVER (PARTITION BY qid, s.url ORDER BY x.score DESC, s.chunk_key) AS nth FROM k JOIN sections s ON s.url = k.url JOIN chunk_scores x USING (qid, chunk_key) WHERE cut = 0 AND rank <= 10)
SELECT qid, rank, url, max(CASE WHEN nth = 1 THEN section END) AS section_title, round(final, 6) AS score, count(section) AS n_sections FROM k LEFT JOIN (SELECT * FROM b WHERE nth <= 3) b USING (qid, url) WHERE cut = 0 AND rank <= 10 GROUP BY qid, rank, url, final""",
    "search_chunks": f"""WITH questions AS ({QUESTIONS}), records AS ({RECORDS}), sections AS ({SECTIONS}), {_bm25_sql('sections', 'chunk_key', 'chunk_scores')},
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_key) AS nth FROM chunk_scores JOIN sections USING (chunk_key) WHERE url LIKE '/en%' AND string_split(url, '/')[2] = 'en'),
f AS (SELECT qid, chunk_key, {BOOSTED} AS final FROM c JOIN questions USING (qid) WHERE nth <= 50), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, chunk_key) AS rank FROM (SELECT *, max(final) OVER (PARTITION BY qid) AS top FROM f) WHERE top <= 0 OR final >= top * 0.7::DOUBLE)
SELECT qid, rank, chunk_key, round(final, 6) AS score FROM t WHERE rank <= 10""",
    "llms_txt": f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM {H_}) WHERE n = 1), h(nth, line) AS (VALUES (1, '# Site'), (2, ''), (3, '> All of it'), (4, ''), (5, '## Pages'), (6, ''))
SELECT nth::BIGINT AS nth, line FROM h UNION ALL SELECT 6 + row_number() OVER (ORDER BY depth, incoming_links DESC, url), '- [' || title || '](https://x.y' || url || ')' || CASE WHEN page_id % 2 = 0 THEN ': about it' ELSE '' END FROM p""",
    "llms_full": f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM {H_}) WHERE n = 1), h(nth, line) AS (VALUES (1, '# Site'), (2, ''))
SELECT nth::BIGINT AS nth, line FROM h UNION ALL SELECT 2 + row_number() OVER (ORDER BY depth, incoming_links DESC, url), '---' || chr(10) || chr(10) || '## [' || title || '](' || url || ')' || chr(10) || chr(10) || regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10) FROM p""",
}
