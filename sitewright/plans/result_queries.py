"""Queries of result lists, custom records, routes, markup files and deletion checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import results as V
from ..functions import scalars as S
from ..operators import diff, pages as P, ranking as R, retrieval
from ..sources import manifest as M, readers
from .base import NORMAL, PAGES_SQL, PATH_SQL, site_pages, table
from .relational_queries import CURRENT, JUDGED, STORED, _current, _judged, _stored
from .scalar_queries import ORACLE as SCALAR, ROUTES

#: A small build manifest and the values of its dynamic routes.
MANIFEST = """export const manifest = { routes: [
 { id: "/", pattern: /^\\/$/, page: { layouts: [0], leaf: 2 }, endpoint: null },
 { id: "/(app)/about", pattern: /^\\/about$/, page: { layouts: [0], leaf: 3 }, endpoint: null },
 { id: "/api/search", pattern: /^\\/api$/, page: null, endpoint: __memo(1) },
 { id: "/blog/[slug]", pattern: /x/, page: { layouts: [0], leaf: 4 }, endpoint: null },
 { id: "/docs/[[lang]]/[...rest]", pattern: /x/, page: { layouts: [0], leaf: 5 }, endpoint: null },
 { id: "/internal/x", pattern: /x/, page: { layouts: [0], leaf: 6 }, endpoint: null } ] }"""
ROUTE_VALUES = {"/blog/[slug]": ["one", "two$1", "draft"]}
COMPONENT = "<!-- @component A button. -->\n<script lang=\"ts\">\ninterface Props { kind: 'a' | 'b'; on?: { x: number }\nsize: number }\nlet { kind = f(1, [2, 3]), size: big = 4, ...rest }: Props = $props();\n</script>\n<b {kind}>Press {size}</b>\n"


def _records(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    content = F.when(F.col("doc_id") % 13 != 0, F.replace(F.col("text"), F.lit("."), F.lit(". \t")))
    return docs.select(F.concat_ws("/", F.lit(" "), "lang", F.lit(""), "doc_id", F.lit("")).alias("url"), F.concat(F.lit("D"), "doc_id").alias("title"), content.alias("content"), F.array("source", "lang").alias("tags"), F.lit(None).cast("double").alias("weight"))


def _custom(s: SparkSession, d: str) -> DataFrame:
    columns = ("url", "title", "custom", F.array_join("tags", ",").alias("tags"), F.sha2("markdown", 256).alias("markdown_sha256"))
    site = site_pages(s, d).select("url", "title", F.lit(False).alias("custom"), F.lit("").alias("tags"), F.lit(None).cast("string").alias("markdown_sha256"))
    return site.unionByName(P.custom_pages(_records(s, d)).select(*columns))


def _excerpts(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", F.concat_ws(" ", F.reverse(F.slice(F.split("text", " "), 40, 3))).alias("query"))
    return P.with_excerpts(docs, "text", "query").select("doc_id", "excerpt")


def _chunk_keys(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    key = S.chunk_key(F.concat(F.lit("/d/"), "doc_id"), F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("source")), F.col("text"), F.lit(0))
    return docs.select("doc_id", key.alias("chunk_key"))


def _routes(s: SparkSession, d: str) -> DataFrame:
    pages = site_pages(s, d).select("page_id", "url")
    least = pages.groupBy("url").agg(F.min("page_id").alias("m")).filter("m % 3 < 2")
    return M.route_lookup(pages, least.select("url", F.when(F.col("m") % 3 == 0, F.lit("src/routes/own/+page.svelte")).otherwise(F.lit("")).alias("route_file")), ROUTES).select("page_id", "route_file", "resolution")


def _talks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


def _sections(s: SparkSession, d: str) -> DataFrame:
    talks = _talks(s, d)
    best = talks.groupBy("conv_id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "conv_id").limit(20)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "conv_id")).cast("long"))  # 20 rows
    return R.with_sections(ranked, talks, "conv_id", "n", "turn").select("conv_id", "rank", "turn", F.col("section_rank").cast("long").alias("section_rank"))


def _stored_turns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").filter("turn % 4 <> 0").select("conv_id", "turn", F.when(F.col("conv_id") % 6 == 0, F.lit("-")).otherwise(F.sha1("text")).alias("content_hash"))


def _changed_turns(s: SparkSession, d: str) -> DataFrame:
    current = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.sha1("text").alias("content_hash"))
    return diff.changed(current, _stored_turns(s, d).select(F.concat_ws(":", "conv_id", "turn").alias("key"), "content_hash"), "key").select("key")


def _get_page(s: SparkSession, d: str) -> DataFrame:
    pages = site_pages(s, d).select("page_id", "url", "title")
    scope = F.when(F.col("page_id") % 20 == 0, F.lit("main")).otherwise(F.lit("other"))
    asked = pages.filter("page_id % 10 = 0").select(S.page_id(F.lit("site"), scope, F.col("url")).alias("id"))
    return retrieval.fetch(pages, asked, "site", "main").select("page_id", "url", "title")


def _gate(s: SparkSession, d: str) -> DataFrame:
    rows = diff.classify(_current(s, d), _stored(s, d), "doc_id")
    return diff.gate_report(rows.withColumn("kind", F.when(F.col("doc_id") % 22 == 0, "risky").when(F.col("doc_id") % 2 == 0, "pages").otherwise("chunks")), "kind")


def _result_urls(s: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, "?a=1&_ssk=old#top").when(F.col("page_id") % 3 == 1, "?b=x%20y").otherwise("")
    section = F.when(F.col("page_id") % 2 == 0, F.col("title"))
    told = F.when(F.col("page_id") % 5 == 0, F.lit("something else ...")).otherwise(F.concat(F.lit("About  "), "title", F.lit(" and one two three four five six seven eight nine ten eleven twelve")))
    return site_pages(s, d).select("page_id", V.result_url(F.concat("url", ending), section, told).alias("result_url"))


def _sub_results(s: SparkSession, d: str) -> DataFrame:
    chunk = F.struct("turn", F.concat(F.when(F.col("turn") % 2 == 0, F.lit(" Role ")).otherwise(F.lit("role ")), F.col("turn") % 6).alias("section"))
    talks = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    picked = V.sub_results(F.lit("Role 1"), F.lit("ROLE 2 "), F.col("chunks"))
    return talks.select("conv_id", F.array_join(F.transform(picked, lambda c: c["turn"].cast("string")), ",").alias("turns"))


def _noise(s: SparkSession, d: str) -> DataFrame:
    best = _judged(s, d).filter("rank = 1")
    return best.agg(F.round(F.avg((F.col("score") < 0.3).cast("int")), 9).alias("rejected"))


def _sitemaps(s: SparkSession, d: str) -> DataFrame:
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), loc, F.lit("<url><loc>ftp://a.b/c</loc></url></urlset>"))
    return readers.sitemap_urls(table(s, d, "pages").select(xml.alias("xml")))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return M.expand_routes(M.manifest_routes(s.createDataFrame([(MANIFEST,)], "manifest string")), ROUTE_VALUES, ["/internal/**", "/blog/draft"])


def _markdown(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    flag = F.when(F.col("doc_id") % 10 == 0, F.lit("noindex: true\n")).when(F.col("doc_id") % 10 == 1, F.lit("search:\n  weight: 0\n")).otherwise(F.lit("search:\n  weight: 2\n  meta: {k: v}\n"))
    text = F.concat(F.lit("---\ntitle: T"), "doc_id", F.lit("\nkeywords: [a, ' b ']\ndate: 2024-02-03\n"), flag, F.lit("---\n"), F.when(F.col("doc_id") % 10 == 2, F.lit(" \n")).otherwise(F.concat(F.lit("# "), "lang")))
    return P.extract_markdown(docs.select(F.concat(F.lit("/"), "lang", F.lit("/"), "doc_id").alias("url"), text.alias("markdown"))).select("url", "status", "title", F.array_join("keywords", ",").alias("keywords"), "weight", "published_ms", F.element_at("meta", "k").alias("k"))


def _components(s: SparkSession, d: str) -> DataFrame:
    files = s.createDataFrame([("src/lib/Button.svelte", COMPONENT), ("src/routes/+page.svelte", "<h1>Hi</h1>{@html x}")], "path string, source string")
    return P.component_pages(files).select("path", "markdown", "is_component")


QUERIES = {
    "custom_records_union": _custom,
    "excerpt": _excerpts,
    "chunk_key": _chunk_keys,
    "route_lookup": _routes,
    "page_sections_topk": _sections,
    "changed_chunks": _changed_turns,
    "get_page": _get_page,
    "deletion_gate": _gate,
    "result_url": _result_urls,
    "breadcrumb": lambda s, d: site_pages(s, d).select("page_id", V.breadcrumb(F.concat("url", F.lit("/getting-started_now.html?q=1#x"))).alias("trail")),
    "sub_results": _sub_results,
    "noise_rejection": _noise,
    "sitemap_urls": _sitemaps,
    "manifest_routes": _manifest,
    "markdown_extract": _markdown,
    "component_pages": _components,
}

MARKDOWN_SHA = "sha256(regexp_replace(regexp_replace(replace(replace(text, '.', '. ' || chr(9)), chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g') || chr(10))"
CAPITALS = "array_to_string(list_transform(string_split(w, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
TRAIL = f"array_to_string(list_transform(list_transform(list_filter(string_split(url, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '\\.\\w+$', ''), '[-_]+', ' ', 'g')), lambda w: {CAPITALS}), ' / ')"
#: A form field keeps * and writes blanks as +; a URI component keeps ! ' ( ) * ~ as well.
FORM = "replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"
COMPONENT_SQL = "replace(replace(replace(replace(replace(url_encode({x}), '%2A', '*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')"
TARGET = "CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN t WHEN page_id % 5 = 0 THEN 'something else' ELSE array_to_string(string_split('About ' || t || ' and one two three four five six seven eight nine ten eleven twelve', ' ')[1:12], ' ') END"

ORACLE = {
    "custom_records_union": f"SELECT url, title, false AS custom, '' AS tags, NULL AS markdown_sha256 FROM ({PAGES_SQL}) UNION ALL SELECT '/' || lang || '/' || doc_id, 'D' || doc_id, true, lang || ',' || source, {MARKDOWN_SHA} FROM documents WHERE doc_id % 13 <> 0 AND regexp_matches(text, '\\S')",
    "chunk_key": """SELECT doc_id, sha1('{"v":1,"kind":"chunk","url":"/d/' || doc_id || '","headings":["' || lang || '","' || source || '"],"text":"' || sha1(text) || '","n":0}') AS chunk_key FROM documents""",
    "route_lookup": f"WITH r AS ({SCALAR['route_map']}), p AS ({PAGES_SQL}), m AS (SELECT url, min(page_id) % 3 AS k FROM p GROUP BY url) SELECT p.page_id, CASE m.k WHEN 0 THEN 'src/routes/own/+page.svelte' WHEN 1 THEN '' ELSE r.route_file END AS route_file, CASE WHEN m.k < 2 THEN 'exact' ELSE r.resolution END AS resolution FROM p JOIN m USING (url) JOIN r USING (page_id)",
    "page_sections_topk": "WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations), b AS (SELECT conv_id, row_number() OVER (ORDER BY sum(n) DESC, conv_id) AS rank FROM t GROUP BY conv_id), x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) AS section_rank FROM t) SELECT b.conv_id, b.rank, x.turn, x.section_rank FROM b LEFT JOIN x ON x.conv_id = b.conv_id AND section_rank <= 5 AND b.rank <= 10 WHERE b.rank <= 20",
    "changed_chunks": "SELECT conv_id || ':' || turn AS key FROM conversations WHERE turn % 4 = 0 OR conv_id % 6 = 0",
    "get_page": f"WITH p AS ({PAGES_SQL}) SELECT page_id, url, title FROM p WHERE url IN (SELECT url FROM p WHERE page_id % 20 = 0)",
    "deletion_gate": f"SELECT CASE WHEN doc_id % 22 = 0 THEN 'risky' WHEN doc_id % 2 = 0 THEN 'pages' ELSE 'chunks' END AS kind, count(b.content_hash) AS n_stored, count(CASE WHEN a.content_hash IS NULL THEN b.content_hash END) AS n_stale, round(CASE WHEN n_stored = 0 THEN 0 ELSE n_stale / n_stored END::DOUBLE, 9) AS ratio, n_stale / greatest(n_stored, 1) > 0.5 AS blocked FROM {CURRENT} a FULL OUTER JOIN {STORED} b USING (doc_id) GROUP BY kind",
    "result_url": f"""WITH p AS (SELECT page_id, url, title, regexp_replace(regexp_replace(title, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM ({PAGES_SQL})), x AS (SELECT *, {TARGET} AS target FROM p)
SELECT page_id, url || '?' || CASE page_id % 3 WHEN 0 THEN 'a=1&' WHEN 1 THEN 'b=x+y&' ELSE '' END || CASE WHEN page_id % 2 = 0 AND title <> '' THEN '_ssk=' || {FORM.format(x='title')} || '&' ELSE '' END || '_sskt=' || {FORM.format(x='target')} || CASE WHEN page_id % 3 = 0 THEN '#top' ELSE '#' END || ':~:text=' || {COMPONENT_SQL.format(x='target')} AS result_url FROM x""",
    "breadcrumb": f"SELECT page_id, CASE WHEN url = '/' THEN '' ELSE {TRAIL} || ' / ' END || 'Getting Started Now' AS trail FROM ({PAGES_SQL})",
    "sub_results": "WITH c AS (SELECT conv_id, turn, turn % 6 AS k FROM conversations), f AS (SELECT conv_id, k, min(turn) AS turn FROM c WHERE k NOT IN (1, 2) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM f) SELECT v.conv_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn), '') AS turns FROM (SELECT DISTINCT conv_id FROM c) v LEFT JOIN r ON r.conv_id = v.conv_id AND nth <= 3 GROUP BY v.conv_id",
    "noise_rejection": f"SELECT round(avg((score < 0.3)::INTEGER), 9) AS rejected FROM {JUDGED} WHERE rank = 1",
    "sitemap_urls": f"SELECT DISTINCT {NORMAL.format(x=PATH_SQL)} AS url FROM pages",
    "manifest_routes": "SELECT * FROM (VALUES ('/', 'src/routes/+page.svelte'), ('/about', 'src/routes/(app)/about/+page.svelte'), ('/blog/one', 'src/routes/blog/[slug]/+page.svelte'), ('/blog/two$1', 'src/routes/blog/[slug]/+page.svelte')) v(url, route_file)",
    "markdown_extract": "SELECT '/' || lang || '/' || doc_id AS url, CASE doc_id % 10 WHEN 0 THEN 'excluded' WHEN 1 THEN 'excluded' WHEN 2 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN doc_id % 10 > 2 THEN 'T' || doc_id ELSE '/' || lang || '/' || doc_id END AS title, CASE WHEN doc_id % 10 > 2 THEN 'a,b' ELSE '' END AS keywords, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END::DOUBLE AS weight, CASE WHEN doc_id % 10 > 2 THEN 1706918400000 END AS published_ms, CASE WHEN doc_id % 10 > 2 THEN 'v' END AS k FROM documents",
    "component_pages": """SELECT * FROM (VALUES ('src/lib/Button.svelte', 'Button component. A button. Props: kind (''a'' | ''b'') default: f(1, [2, 3]), size (number) default: 4.' || chr(10) || chr(10) || 'Press', true), ('src/routes/+page.svelte', 'Hi', false)) v(path, markdown, is_component)""",
}
