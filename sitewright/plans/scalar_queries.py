"""Queries of the scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import results as V
from ..functions import scalars as S
from ..operators import index as I, pages as G, ranking as R, search as H
from .base import DEPTH_SQL, NORMAL, PAGES_SQL, site_pages, table

WEIGHTS = {"/en/**": 1.5, "/de/*": 0.5, "/fr/**": 0.0}
ROBOTS = "User-agent: *\nDisallow: /es/  # not yet\nDisallow: /de/7\nAllow: /de/77\n\nUser-agent: other\nDisallow: /\n"
ROUTES = ["src/routes/+page.svelte", "src/routes/en/[id]/+page.svelte", "src/routes/(app)/[lang]/[...rest]/+page.svelte", "src/routes/de/[[page]]/+page.svelte"]
DURATIONS = ("30d", "12h", "15m", "45s", "500ms", "7 d", "d", "3D")
ERRORS = ((401, "filter"), (429, ""), (504, "x"), (502, "bad filter"), (None, "sparseVector broke"), (None, "Rate limit"), (None, "request timed out"), (None, "parse error near"), (None, "fetch failed"), (None, "namespace not found: a"), (500, "Missing namespace"), (404, "Forbidden"))


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_pages(spark, sf_dir).select("page_id", "url")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with typed metadata: a number, a truth and a list."""
    typed = lambda kind, raw: S.meta_value(F.lit(kind), raw)
    kinds = F.concat(F.lit("k"), F.col("doc_id") % 3, F.lit(",all"))
    meta = F.create_map(F.lit("quality"), typed("number", F.col("quality").cast("string")), F.lit("toxic"), typed("boolean", F.col("toxic").cast("string")), F.lit("kind"), typed("string[]", kinds))
    return table(spark, sf_dir, "labels").select("doc_id", meta.alias("meta"))


QUERIES = {
    "url_normalize": lambda s, d: _pages(s, d),
    "resolve_path": lambda s, d: table(s, d, "pages").select("page_id", S.resolve_path(F.concat(F.lit(" "), S.resolve_path(F.col("url")), F.lit("//?q=1#x"))).alias("path")),
    "url_depth": lambda s, d: _pages(s, d).select("page_id", S.url_depth(F.col("url")).cast("long").alias("depth")),
    "url_humanize": lambda s, d: _pages(s, d).select("page_id", S.humanize_url_path(F.col("url")).alias("label")),
    "html_file_to_url": lambda s, d: _pages(s, d).select("page_id", S.html_file_to_url(F.concat(F.substring("url", 2, 1000), F.when(F.col("page_id") % 2 == 0, "/index.html").otherwise(".html"))).alias("file_url")),
    "record_ids": lambda s, d: _pages(s, d).select("page_id", S.page_id(F.lit("site"), F.lit("main"), F.col("url")).alias("record_id")),
    "record_urls": lambda s, d: _pages(s, d).select("page_id", S.url_of_page_id(S.page_id(F.lit("site"), F.when(F.col("page_id") % 2 == 0, "main").otherwise("other"), F.col("url")), F.lit("site"), F.lit("main")).alias("url")),
    "meta_content": lambda s, d: _labelled(s, d).select("doc_id", *[S.meta_content(F.col("meta")[k]).alias(k) for k in ("quality", "toxic", "kind")]),
    "wrap_index": lambda s, d: _docs(s, d).select("doc_id", V.wrap_index(F.col("doc_id") % 17 - 8, F.col("doc_id") % 4).alias("at")),
    "text_normalize": lambda s, d: _docs(s, d).select("doc_id", S.normalize_text(F.col("text")).alias("t")),
    "md_normalize": lambda s, d: _docs(s, d).select("doc_id", S.normalize_markdown(F.replace(F.col("text"), F.lit("."), F.lit(". \t"))).alias("t")),
    "md_to_plain": lambda s, d: _docs(s, d).select("doc_id", S.markdown_to_plain(F.col("text")).alias("t")),
    "snippet": lambda s, d: _docs(s, d).select("doc_id", S.snippet(F.col("text")).alias("snippet")),
    "content_hash": lambda s, d: _docs(s, d).select("doc_id", F.sha1("text").alias("h1"), F.sha2("text", 256).alias("h2")),
    "scope_sanitize": lambda s, d: _docs(s, d).select("doc_id", S.sanitize_scope(F.concat(F.lit("/"), F.col("text"))).alias("scope")),
    "page_summary": lambda s, d: _docs(s, d).select("doc_id", S.page_summary(F.col("source"), F.col("lang"), F.array("lang", "source"), F.col("text")).alias("summary")),
    "page_hash": lambda s, d: _docs(s, d).select("doc_id", S.page_hash(F.col("source"), F.lit(None).cast("string"), F.array("source", "lang"), F.array("lang"), F.col("text"), F.lit(2), F.col("n_chars"), F.lit(""), F.col("doc_id") % 2 == 0, F.lit(None).cast("double"), F.array(F.lit("/b"), F.lit("/a")), F.lit("{}")).alias("hash")),
    "embedding_text": lambda s, d: _docs(s, d).select("doc_id", S.embedding_text(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text")).alias("t")),
    "summary_chunks": lambda s, d: _docs(s, d).select("doc_id", F.lit(0).alias("ordinal"), G.summary_text(F.col("source"), F.concat(F.lit("/"), "lang", F.lit("/"), "source"), S.snippet(F.col("text")), F.col("text"), F.array().cast("array<string>")).alias("chunk_text")),
    "embedding_title": lambda s, d: _docs(s, d).select("doc_id", G.embedding_title(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))).alias("t")),
    "join_url": lambda s, d: _pages(s, d).select("page_id", S.join_url(F.when(F.col("page_id") % 2 == 0, "https://x.y//").otherwise("https://x.y"), F.when(F.col("page_id") % 3 == 0, F.substring("url", 2, 1 << 30)).otherwise(F.col("url"))).alias("full_url")),
    "clamp_int": lambda s, d: table(s, d, "customer").select("c_custkey", S.clamp_int(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), 1, 500, 90).alias("n")),
    "retryable": lambda s, d: _values(s, list(ERRORS), "status int, message string").select("status", "message", S.retryable(S.error_class(F.col("status"), F.col("message"))).alias("again")),
    "anchor_normalize": lambda s, d: _links(s, d).select("page_id", "pos", S.normalize_anchor(F.col("anchor_text")).alias("anchor")),
    "links_extract": lambda s, d: _links(s, d),
    "html_title": lambda s, d: site_pages(s, d).select("page_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")).alias("title")),
    "title_match": lambda s, d: site_pages(s, d).select("page_id", S.matches_either_way(F.lit("The"), F.col("title")).alias("hit")),
    "url_pattern_match": lambda s, d: _pages(s, d).select("page_id", P.matches(F.col("url"), "/en/**").alias("below"), P.matches(F.col("url"), "/de/*").alias("one"), P.matches(F.col("url"), "/es/").alias("exact")),
    "page_weight": lambda s, d: _pages(s, d).select("page_id", P.weight_for(F.col("url"), WEIGHTS).alias("weight")),
    "weight_filter": lambda s, d: _pages(s, d).withColumn("own", F.when(F.col("page_id") % 5 == 0, 0.0).when(F.col("page_id") % 5 == 1, 2.0)).select("page_id", P.effective_weight(F.col("url"), F.col("own"), WEIGHTS).alias("weight")).filter("weight <> 0"),
    "exclude_list": lambda s, d: _pages(s, d).filter(~P.matches_any(F.col("url"), ["/en/**", "/es/", "/de/*"])),
    "content_file_url": lambda s, d: _docs(s, d).select("doc_id", S.content_file_to_url(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("src/routes/(app)/"), "lang", F.lit("/[id]/[...rest]/+page.svelte"))).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "lang", "doc_id", F.lit("index.md"))).otherwise(F.concat("lang", F.lit("//"), "doc_id", F.lit(".md")))).alias("url")),
    "anchor_boost": lambda s, d: site_pages(s, d).select("page_id", F.round(R.boosted(F.lit(1.0), F.col("page_id") % 5, F.lit(2), F.lit("none"), F.lit("The"), R.Boosts(use_anchor=True), anchor=F.col("title"))["final"], 6).alias("final")),
    "highlight_parts": lambda s, d: site_pages(s, d).select("page_id", F.array_join(F.transform(V.highlight_parts(F.col("title"), F.lit(" the  a+b")), lambda p: F.when(p["match"], F.concat(F.lit("<"), p["text"], F.lit(">"))).otherwise(p["text"])), "").alias("shown")),
    "robots_filter": lambda s, d: _pages(s, d).filter(~P.blocked_by_robots(F.col("url"), P.parse_robots(ROBOTS, "sitewright"))),
    "filter_path_prefix": lambda s, d: _pages(s, d).filter(H.below(F.col("url"), "e")),
    "filter_tags_all": lambda s, d: _docs(s, d).filter(H.has_tags(F.array("lang", "source"), ("en", "src1"))).select("doc_id"),
    "filter_meta": lambda s, d: _labelled(s, d).filter(H.meta_matches(F.col("meta"), {"quality": 1, "toxic": False, "kind": "k1", "not a name": "x"})).select("doc_id"),
    "scope_isolation": lambda s, d: I.in_scope(_docs(s, d).withColumns({"project_id": F.col("lang"), "scope_name": F.col("source")}), "en", "src3").select("doc_id", "source", "lang"),
    "route_map": lambda s, d: _pages(s, d).withColumn("r", P.route_for(F.col("url"), ROUTES)).select("page_id", "r.route_file", "r.resolution"),
    "duration_ms": lambda s, d: _values(s, [(x,) for x in DURATIONS], "raw string").select("raw", S.duration_ms(F.col("raw")).alias("ms")),
    "error_class": lambda s, d: _values(s, list(ERRORS), "status int, message string").select("status", "message", S.error_class(F.col("status"), F.col("message")).alias("code")),
    "date_to_ms": lambda s, d: table(s, d, "orders").select("o_orderkey", S.date_to_ms(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ms")),
    "meta_parse": lambda s, d: _docs(s, d).withColumn("m", S.meta_value(F.element_at(F.array(F.lit("number"), F.lit("boolean"), F.lit("string[]"), F.lit("string")), (F.col("doc_id") % 4 + 1).cast("int")), F.element_at(F.array(F.lit("1.5"), F.lit("true"), F.lit("a, b,,c"), F.col("lang")), (F.col("doc_id") % 4 + 1).cast("int")))).select("doc_id", "m.s", "m.d", "m.b", F.array_join("m.a", "|").alias("a")),
    "freshness_boost": lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(R.boosted(F.lit(0.0), F.lit(0), F.lit(0), F.lit(""), F.lit(""), R.Boosts(use_freshness=True), F.unix_millis(F.col("o_orderdate").cast("timestamp")), 1_000_000_000_000)["freshness_boost"], 6).alias("boost")),
    "dice_path": lambda s, d: _pages(s, d).select("page_id", F.round(S.dice_path(F.col("url"), F.lit("/en/1000")), 9).alias("dice")),
}


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor of a page in order: page_id, url, pos, dst_url, anchor_text."""
    anchors = F.expr(r"""regexp_extract_all(html, '<a href="([^"#][^"]*)">([^<]*)</a>', 0)""")
    rows = site_pages(spark, sf_dir).select("page_id", "url", F.posexplode(anchors).alias("pos", "tag"))
    return rows.select("page_id", "url", F.col("pos").cast("long").alias("pos"), S.normalize_url_path(F.regexp_extract("tag", '<a href="([^"]*)"', 1)).alias("dst_url"), F.regexp_extract("tag", ">([^<]*)</a>", 1).alias("anchor_text"))


links = _links
BLANK = "regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
PLAIN = BLANK.format(x="regexp_replace(regexp_replace(regexp_replace(text, '```[\\s\\S]*?```', ' ', 'g'), '`([^`]+)`', '\\1', 'g'), '[#>*_|\\-]', ' ', 'g')")
SNIPPET = f"CASE WHEN length({PLAIN}) <= 220 THEN {PLAIN} ELSE regexp_replace(left({PLAIN}, 219), '^\\s+|\\s+$', '', 'g') || '…' END"
LINKS_SQL = f"""SELECT page_id, url, (pos - 1)::BIGINT AS pos, {NORMAL.format(x="regexp_extract(tag, '<a href=\"([^\"]*)\"', 1)")} AS dst_url, regexp_extract(tag, '>([^<]*)</a>', 1) AS anchor_text
FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"#][^"]*)">([^<]*)</a>', 0) AS tags FROM ({PAGES_SQL})))"""
P_ = f"({PAGES_SQL})"
WEIGHT_SQL = "CASE WHEN url = '/en' OR url LIKE '/en/%' THEN 1.5 WHEN url = '/fr' OR url LIKE '/fr/%' THEN 0.0 WHEN regexp_full_match(url, '/de/[^/]+') THEN 0.5 ELSE 1.0 END::DOUBLE"
TITLE_SQL = BLANK.format(x="regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g')")
VALUES_ERRORS = ", ".join(f"({'NULL' if a is None else a}::INTEGER, '{b}')" for a, b in ERRORS)
VALUES_DURATIONS = ", ".join(f"('{x}')" for x in DURATIONS)

ORACLE = {
    "url_normalize": f"SELECT page_id, url FROM {P_}",
    "resolve_path": f"SELECT page_id, url AS path FROM {P_}",
    "url_depth": f"SELECT page_id, {DEPTH_SQL} AS depth FROM {P_}",
    "url_humanize": f"SELECT page_id, array_to_string(list_transform(list_filter(string_split(url, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '[-_]', ' ', 'g')), ' / ') AS label FROM {P_}",
    "html_file_to_url": f"SELECT page_id, url AS file_url FROM {P_}",
    "record_ids": f"SELECT page_id, 'ss:1:site:main:page:' || replace(url_encode(url), '+', '%20') AS record_id FROM {P_}",
    "record_urls": f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS url FROM {P_}",
    "meta_content": "SELECT doc_id, quality::VARCHAR AS quality, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS toxic, 'k' || (doc_id % 3) || ',all' AS kind FROM labels",
    "wrap_index": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE ((doc_id % 17 - 8) % (doc_id % 4) + doc_id % 4) % (doc_id % 4) END::BIGINT AS at FROM documents",
    "text_normalize": f"SELECT doc_id, {BLANK.format(x='text')} AS t FROM documents",
    "md_normalize": "SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, '.', '. ' || chr(9)), chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) AS t FROM documents",
    "md_to_plain": f"SELECT doc_id, {PLAIN} AS t FROM documents",
    "snippet": f"SELECT doc_id, {SNIPPET} AS snippet FROM documents",
    "content_hash": "SELECT doc_id, sha1(text) AS h1, sha256(text) AS h2 FROM documents",
    "scope_sanitize": "SELECT doc_id, left(regexp_replace(regexp_replace(lower('/' || text), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS scope FROM documents",
    "page_summary": f"""WITH b AS (SELECT doc_id, source, lang, {BLANK.format(x="regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[\\s\\S]*?```', ' ', 'g'), '`([^`]+)`', '\\1', 'g'), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^#{1,6}\\s+', '', 'g'), '[>*_|~\\-]', ' ', 'g')")} AS body FROM documents),
j AS (SELECT doc_id, source || chr(10) || chr(10) || lang || chr(10) || chr(10) || lang || ', ' || source || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END AS t FROM b)
SELECT doc_id, CASE WHEN length(t) <= 3500 THEN t ELSE regexp_replace(left(t, 3500), '^\\s+|\\s+$', '', 'g') END AS summary FROM j""",
    "page_hash": "SELECT doc_id, sha256(source || '||' || array_to_string(list_sort([source, lang]), ',') || '|' || lang || '|' || text || '|2|' || n_chars::VARCHAR || '||' || CASE WHEN doc_id % 2 = 0 THEN 'custom' ELSE 'site' END || '||/a,/b|{}') AS hash FROM documents",
    "embedding_text": "SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN ' — ' || lang ELSE '' END || chr(10) || chr(10) || text AS t FROM documents",
    "summary_chunks": f"SELECT doc_id, 0 AS ordinal, source || chr(10) || chr(10) || lang || ' / ' || source || chr(10) || chr(10) || {SNIPPET} AS chunk_text FROM documents",
    "anchor_normalize": f"WITH a AS (SELECT page_id, pos, lower({BLANK.format(x='anchor_text')}) AS x FROM ({LINKS_SQL})) SELECT page_id, pos, CASE WHEN length(x) < 3 OR x IN ('here', 'click', 'click here', 'read more', 'link', 'this', 'more') THEN '' ELSE left(x, 100) END AS anchor FROM a",
    "links_extract": LINKS_SQL,
    "html_title": f"SELECT page_id, coalesce(nullif(title, ''), url) AS title FROM {P_}",
    "title_match": f"SELECT page_id, ({TITLE_SQL} <> '' AND (contains({TITLE_SQL}, 'the') OR contains('the', {TITLE_SQL}))) AS hit FROM {P_}",
    "url_pattern_match": f"SELECT page_id, (url = '/en' OR url LIKE '/en/%') AS below, regexp_full_match(url, '/de/[^/]+') AS one, url = '/es' AS exact FROM {P_}",
    "page_weight": f"SELECT page_id, {WEIGHT_SQL} AS weight FROM {P_}",
    "weight_filter": f"WITH w AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 2.0 END AS own, {WEIGHT_SQL} AS config FROM {P_}) SELECT page_id, coalesce(own, config)::DOUBLE AS weight FROM w WHERE coalesce(own, 1) <> 0 AND config <> 0",
    "exclude_list": f"SELECT page_id, url FROM {P_} WHERE NOT (url = '/en' OR url LIKE '/en/%' OR url = '/es' OR regexp_full_match(url, '/de/[^/]+'))",
    "content_file_url": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/' || lang || '/param/splat' ELSE '/' || lang || '/' || doc_id END AS url FROM documents",
    "anchor_boost": f"SELECT page_id, round(1::DOUBLE + ln(1 + (page_id % 5)::DOUBLE) * 0.05::DOUBLE + 0.01::DOUBLE + CASE WHEN {TITLE_SQL} <> '' AND (contains({TITLE_SQL}, 'the') OR contains('the', {TITLE_SQL})) THEN 0.1::DOUBLE ELSE 0 END, 6) AS final FROM {P_}",
    "highlight_parts": f"SELECT page_id, regexp_replace(title, '(?i)(the|a\\+b)', '<\\1>', 'g') AS shown FROM {P_}",
    "robots_filter": f"SELECT page_id, url FROM {P_} WHERE NOT (greatest(CASE WHEN url LIKE '/es/%' THEN 4 ELSE 0 END, CASE WHEN url LIKE '/de/7%' THEN 5 ELSE 0 END) > CASE WHEN url LIKE '/de/77%' THEN 6 ELSE 0 END)",
    "filter_path_prefix": f"SELECT page_id, url FROM {P_} WHERE url LIKE '/e%'",
    "filter_tags_all": "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'",
    "filter_meta": "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id % 3 = 1",
    "embedding_title": "SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN ' > ' || lang || ' > ' || source WHEN doc_id % 2 = 0 THEN ' > ' || lang ELSE '' END AS t FROM documents",
    "join_url": f"SELECT page_id, 'https://x.y' || url AS full_url FROM {P_}",
    "clamp_int": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 90 ELSE least(500, greatest(1, floor(c_acctbal))) END::BIGINT AS n FROM customer",
    "retryable": f"SELECT status, message, (coalesce(status IN (408, 429, 504) OR status >= 500, false) AND NOT regexp_matches(lower(message), '\\b((unknown|missing) namespace|namespace not found)\\b')) OR (coalesce(status, 0) NOT IN (401, 403) AND coalesce(status, 0) < 500 AND regexp_matches(lower(message), '\\b(rate limit|too many|timed out|timeout|fetch failed|network|unavailable)\\b')) AS again FROM (VALUES {VALUES_ERRORS}) v(status, message)",
    "scope_isolation": "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'",
    "route_map": f"SELECT page_id, CASE WHEN regexp_full_match(url, '//?') THEN 'src/routes/+page.svelte' WHEN regexp_full_match(url, '/en/[^/]+/?') THEN 'src/routes/en/[id]/+page.svelte' WHEN regexp_full_match(url, '/de(?:/[^/]+)?/?') THEN 'src/routes/de/[[page]]/+page.svelte' WHEN regexp_full_match(url, '/[^/]+/.+/?') THEN 'src/routes/(app)/[lang]/[...rest]/+page.svelte' ELSE 'src/routes/+page.svelte' END AS route_file, CASE WHEN regexp_full_match(url, '//?') OR regexp_full_match(url, '/en/[^/]+/?') OR regexp_full_match(url, '/de(?:/[^/]+)?/?') OR regexp_full_match(url, '/[^/]+/.+/?') THEN 'exact' ELSE 'best-effort' END AS resolution FROM {P_}",
    "duration_ms": f"SELECT raw, CASE WHEN regexp_full_match(raw, '(?i)\\d+(ms|s|m|h|d)') THEN regexp_extract(raw, '^(\\d+)', 1)::BIGINT * CASE lower(regexp_extract(raw, '([a-zA-Z]+)$', 1)) WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 ELSE 86400000 END END AS ms FROM (VALUES {VALUES_DURATIONS}) v(raw)",
    "error_class": f"""SELECT status, message, CASE WHEN regexp_matches(lower(message), '\\b((unknown|missing) namespace|namespace not found)\\b') THEN 'NAMESPACE_MISSING' WHEN status IN (401, 403) THEN 'UNAUTHORIZED' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status IN (408, 504) THEN 'TIMEOUT' WHEN status >= 500 THEN 'SERVICE_UNAVAILABLE'
WHEN regexp_matches(lower(message), '\\b(credentials|forbidden|permission|token|unauthorized)\\b') THEN 'UNAUTHORIZED' WHEN regexp_matches(lower(message), '\\b(quota|rate limit|slow down|throttled|too many)\\b') THEN 'RATE_LIMITED' WHEN regexp_matches(lower(message), '\\b(deadline|timed out|timeout)\\b') THEN 'TIMEOUT' WHEN regexp_matches(lower(message), '\\b(filter|parse|syntax)\\b') THEN 'INVALID_FILTER'
WHEN regexp_matches(lower(message), '\\b(connection|fetch failed|gateway|host|network|refused|reset|unavailable)\\b') THEN 'SERVICE_UNAVAILABLE' ELSE 'UNKNOWN' END AS code FROM (VALUES {VALUES_ERRORS}) v(status, message)""",
    "date_to_ms": "SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) AS ms FROM orders",
    "meta_parse": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN lang END AS s, CASE WHEN doc_id % 4 = 0 THEN 1.5::DOUBLE END AS d, CASE WHEN doc_id % 4 = 1 THEN true END AS b, CASE WHEN doc_id % 4 = 2 THEN 'a|b|c' END AS a FROM documents",
    "freshness_boost": "SELECT o_orderkey, round(0.1::DOUBLE / (1 + greatest(0::DOUBLE, (1000000000000 - epoch_ms(o_orderdate)) / 86400000::DOUBLE) * 0.001::DOUBLE), 6) AS boost FROM orders",
    "dice_path": f"WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '') AS a FROM {P_}) SELECT page_id, round(2.0::DOUBLE * CASE WHEN a[1] = 'en' AND a[2] = '1000' THEN 2 WHEN a[1] = 'en' THEN 1 ELSE 0 END / (len(a) + 2), 9) AS dice FROM p",
}
