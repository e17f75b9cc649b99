"""Queries of links, diffs, ranking and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import diff, index as I, links as L, pages as G, ranking as R, retrieval, search as H
from .base import DEPTH_SQL, PAGES_SQL, site_pages, table
from .scalar_queries import BLANK, LINKS_SQL, links as page_links


def _edges(s: SparkSession, d: str) -> DataFrame:
    return page_links(s, d).select(F.col("url").alias("src_url"), "dst_url", "anchor_text", F.struct("page_id", "pos").alias("pos"))


def _targets(s: SparkSession, d: str) -> DataFrame:
    """The pages that links lead to, but for those on a few letters, so that some links lead nowhere."""
    return page_links(s, d).select(F.col("dst_url").alias("url")).distinct().filter(~F.lower(F.substring("url", 2, 1)).isin("a", "t"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    """A score for each page: how large a share of its title's words is `the`."""
    words = F.split(F.lower("title"), " ")
    share = F.size(F.filter(words, lambda w: w == "the")) / F.size(words)
    return site_pages(s, d).select("page_id", "url", "title", F.lit("the").alias("query"), (share + 0.5).alias("score"), S.url_depth(F.col("url")).alias("depth"), (F.col("page_id") % 7).alias("incoming_links"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    p = R.boosted(F.col("score"), F.col("incoming_links"), F.col("depth"), F.col("title"), F.col("query"))
    return _hits(s, d).select("page_id", "url", *[F.round(c, 6).alias(n) for n, c in p.items()])


def _runs(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select((F.col("page_id") % 5).alias("qid"), "page_id", F.concat_ws("#", "url", "page_id").alias("url"), F.col("final").alias("final_score"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").filter("doc_id % 10 <> 0")
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("-")).otherwise(F.sha1("text")).alias("content_hash"), (F.col("doc_id") % 4 == 0).alias("custom"))


def _current(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").filter("doc_id % 11 <> 0").select("doc_id", F.sha1("text").alias("content_hash"))


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id divides by 20 as queries."""
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))


def _knn(s: SparkSession, d: str, k: int = 10) -> DataFrame:
    scored = retrieval.dense(*_vectors(s, d)).filter("id <> qid").withColumn("score", F.round("score", 6))
    return retrieval.top(scored, k).select("qid", F.col("id").alias("vec_id"), "score")


def _judged(s: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id divides by 20, ranked are all others, relevant those of the same label."""
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = labels.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("label").alias("q_label"))
    scored = retrieval.dense(*_vectors(s, d)).filter("id <> qid").join(labels, "id").join(asked, "qid")
    scored = scored.select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), (F.col("label") == F.col("q_label")).cast("int").alias("relevance"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")))


def _asserted(s: SparkSession, d: str) -> DataFrame:
    """Even queries expect their first result, odd ones their second, all of them their third and, of some, the tenth."""
    ranked = _judged(s, d).select("qid", F.col("vec_id").alias("url"), "rank")
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("url")))
    picked = ranked.groupBy("qid").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"), at(10).alias("d"), F.count("*").alias("n"))
    even, third = F.col("qid") % 40 == 0, F.col("qid") % 60 == 0
    expected = picked.select("qid", F.when(even, F.col("a")).otherwise(F.col("b")).alias("top_result"), F.when(third, F.array("c")).otherwise(F.array("c", "d")).alias("in_top_5"), F.when(~third, F.col("n") - F.when(even, 0).otherwise(1)).alias("max_results"))
    return R.assertions(ranked, expected)


def _related(s: SparkSession, d: str) -> DataFrame:
    """The first page's; pages link to the page of half their number, and have the vector of their number."""
    pages = diff.dedupe_first(site_pages(s, d).select("page_id", "url", "title"), "url", "page_id")
    half = pages.select(F.floor(F.col("page_id") / 2).alias("page_id"), F.col("url").alias("src_url"))
    edges = half.join(pages.select("page_id", F.col("url").alias("dst_url")), "page_id")
    vectors = pages.select("page_id", "url").join(table(s, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("v")), "page_id")
    source = pages.orderBy("page_id").first()["url"]
    return H.related_pages(source, pages, edges, vectors, 25)


def _stored_docs(s: SparkSession, d: str) -> DataFrame:
    """Documents as stored records: project, scope, kind, time of indexing and version of their layout."""
    docs = table(s, d, "documents")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))
    return docs.select("doc_id", F.col("lang").alias("project_id"), F.col("source").alias("scope_name"), F.when(F.col("doc_id") % 2 == 0, "page").otherwise("chunk").alias("kind"), F.when(F.col("doc_id") % 5 == 0, "never").otherwise(day).alias("indexed_at"), F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 0).otherwise(1).alias("schema_version"))


def _public(s: SparkSession, d: str) -> DataFrame:
    section = F.struct(F.col("title").alias("section_title"), F.col("url").alias("chunk_text"))
    shown = H.public(_hits(s, d).select("page_id", "url", "depth", F.lit("src/x").alias("route_file"), F.col("title").alias("chunk_text"), F.lit(1).alias("breakdown"), F.array(section, section).alias("chunks")))
    return shown.withColumn("chunks", F.transform("chunks", lambda c: c["section_title"])).withColumn("chunks", F.array_join("chunks", "|"))


QUERIES = {
    "dedupe_first": lambda s, d: diff.dedupe_first(site_pages(s, d).select("page_id", "url"), "url", "page_id"),
    "link_semi_join": lambda s, d: L.known_links(_edges(s, d), _targets(s, d)).select("src_url", "dst_url", F.col("pos.page_id").alias("page_id"), F.col("pos.pos").alias("pos")),
    "incoming_links": lambda s, d: L.with_incoming(_targets(s, d), _edges(s, d)),
    "anchor_rollup": lambda s, d: L.anchor_rollup(_edges(s, d)),
    "graph_bfs_reach": lambda s, d: L.reach(_tree_edges(s, d), s.createDataFrame([("/",)], "url string"), 4),
    "site_tree": lambda s, d: L.site_tree(site_pages(s, d).select("url", "title")),
    "site_subtree": lambda s, d: L.subtree(L.site_tree(site_pages(s, d).select("url", "title")), "en/"),
    "site_structure": lambda s, d: L.site_structure(diff.dedupe_first(site_pages(s, d), "url", "page_id"), most=100)[0].select("url", "is_indexed", "child_count"),
    "changed_pages": lambda s, d: diff.changed(_current(s, d), _stored(s, d), "doc_id").select("doc_id"),
    "stale_pages": lambda s, d: diff.stale(_stored(s, d), _current(s, d), "doc_id", custom_records_given=False).select("doc_id"),
    "stale_chunks": lambda s, d: diff.stale(_stored(s, d), _current(s, d), "doc_id").select("doc_id"),
    "run_stats": lambda s, d: diff.classify(_current(s, d), _stored(s, d), "doc_id").groupBy("status").agg(F.count("*").alias("n")),
    "deletion_ratio": lambda s, d: diff.classify(_current(s, d), _stored(s, d), "doc_id").filter("status <> 'new'").agg(F.round(F.avg((F.col("status") == "stale").cast("int")), 9).alias("ratio"), (F.avg((F.col("status") == "stale").cast("int")) <= 0.5).alias("eligible")),
    "collision_ordinal": lambda s, d: diff.collision_ordinals(table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")), ["doc_id", "line"], "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("nth").cast("long").alias("nth")),
    "scope_inventory": lambda s, d: I.scope_inventory(_stored_docs(s, d), "en"),
    "hash_manifest": lambda s, d: I.inventory(_stored(s, d), "doc_id"),
    "legacy_scan": lambda s, d: I.legacy_counts(_stored_docs(s, d), "en"),
    "legacy_delete": lambda s, d: I.without_legacy(_stored_docs(s, d), "en").select("doc_id"),
    "page_markdown": lambda s, d: G.reassembled(table(s, d, "conversations"), "conv_id", "turn"),
    "list_pages": lambda s, d: I.page_after(diff.dedupe_first(site_pages(s, d).select("page_id", "url"), "url", "page_id"), "/en/5"),
    "limit_max_pages": lambda s, d: site_pages(s, d).select("url", "page_id").orderBy("url", "page_id").limit(100),
    "llms_txt_lines": lambda s, d: R.numbered(_hits(s, d).select(F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")")).alias("line"), "depth", "incoming_links", "url", "page_id"), F.struct("depth", (-F.col("incoming_links")).alias("links"), "url", "page_id")).select("nth", "line"),
    "prune_scopes": lambda s, d: diff.select_stale_scopes(table(s, d, "events").groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_indexed_ms")).select(F.concat(F.lit("u"), "user_id").alias("scope_name"), "last_indexed_ms"), ["u1", "u2"], ["u3"], 1_800_000_000_000, 86_400_000).select("scope_name"),
    "boost_rank": lambda s, d: _scored(s, d).select("page_id", "final"),
    "score_breakdown": lambda s, d: _scored(s, d).drop("url"),
    "topk_rank": lambda s, d: R.rank_pages(_hits(s, d).withColumn("url", F.concat_ws("#", "url", "page_id")), 20).select("page_id", F.round("final_score", 6).alias("final_score")),
    "min_score_ratio": lambda s, d: R.trim(_runs(s, d), gap=False).select("qid", "page_id"),
    "chunk_mode_rank": lambda s, d: R.trim(_runs(s, d), R.Boosts(min_score_ratio=0.9), gap=False).select("qid", "page_id", "final_score"),
    "score_gap_trim": lambda s, d: R.trim(_runs(s, d), R.Boosts(min_score_ratio=0.1, score_gap=0.02)).select("qid", "page_id"),
    "knn_cosine": _knn,
    "related_pages": _related,
    "mrr": lambda s, d: R.measures(_judged(s, d), 5).agg(F.round(F.avg("reciprocal_rank"), 9).alias("mrr")),
    "precision_at_k": lambda s, d: R.measures(_judged(s, d), 5).select("qid", F.round("precision", 9).alias("precision")),
    "ndcg_at_k": lambda s, d: R.measures(_judged(s, d), 5).select("qid", F.round("ndcg", 9).alias("ndcg")),
    "quality_assertions": _asserted,
    "public_results": _public,
}


def _tree_edges(s: SparkSession, d: str) -> DataFrame:
    return L.site_tree(site_pages(s, d).select("url", "title")).filter("parent_url IS NOT NULL").select(F.col("parent_url").alias("src_url"), F.col("url").alias("dst_url"))


E_ = f"(SELECT url AS src_url, dst_url, anchor_text, page_id, pos FROM ({LINKS_SQL}))"
T_ = f"(SELECT DISTINCT dst_url AS url FROM {E_} WHERE lower(substr(dst_url, 2, 1)) NOT IN ('a', 't'))"
TITLE = BLANK.format(x="regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g')")
H_ = f"(SELECT page_id, url, title, len(list_filter(string_split(lower(title), ' '), lambda w: w = 'the')) / len(string_split(lower(title), ' '))::DOUBLE + 0.5::DOUBLE AS score, {DEPTH_SQL} AS depth, page_id % 7 AS incoming_links FROM ({PAGES_SQL}))"
PARTS = f"score AS base, ln(1 + incoming_links::DOUBLE) * 0.05::DOUBLE AS link_boost, 0.03::DOUBLE / (1 + depth) AS depth_boost, CASE WHEN {TITLE} <> '' AND (contains({TITLE}, 'the') OR contains('the', {TITLE})) THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS title_boost"
B_ = f"(SELECT *, base + link_boost + depth_boost + title_boost AS final FROM (SELECT page_id, url, {PARTS} FROM {H_}))"
RUN_ = f"(SELECT page_id % 5 AS qid, page_id, url || '#' || page_id AS url, round(final, 6) AS final_score FROM {B_})"
STORED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '-' ELSE sha1(text) END AS content_hash, doc_id % 4 = 0 AS custom FROM documents WHERE doc_id % 10 <> 0)"
CURRENT = "(SELECT doc_id, sha1(text) AS content_hash FROM documents WHERE doc_id % 11 <> 0)"
CLASSES = f"(SELECT CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'stale' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'same' END AS status FROM {CURRENT} a FULL OUTER JOIN {STORED} b ON a.doc_id = b.doc_id)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COS = f"round({DOT.format(a='a.embedding', b='q.embedding')} / sqrt({DOT.format(a='a.embedding', b='a.embedding')} * {DOT.format(a='q.embedding', b='q.embedding')}), 6)"
COS_EXACT = f"{DOT.format(a='a.embedding', b='q.embedding')} / sqrt({DOT.format(a='a.embedding', b='a.embedding')} * {DOT.format(a='q.embedding', b='q.embedding')})"
JUDGED = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS qid, a.vec_id, (a.label = q.label)::INTEGER AS relevance, {COS} AS score FROM embeddings a, embeddings q WHERE a.vec_id <> q.vec_id AND q.vec_id % 20 = 0))"
STORED_DOCS = "(SELECT doc_id, lang AS project_id, source AS scope_name, CASE WHEN doc_id % 2 = 0 THEN 'page' ELSE 'chunk' END AS kind, CASE WHEN doc_id % 5 <> 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00' END AS read_at, doc_id % 3 <> 2 AS legacy FROM documents)"
NODES = f"(SELECT DISTINCT node FROM (SELECT unnest(list_transform(range(0, len(p) + 1), lambda n: '/' || array_to_string(p[1:n], '/'))) AS node FROM (SELECT list_filter(string_split(url, '/'), lambda s: s <> '') AS p FROM ({PAGES_SQL}))))"
TREE = f"(SELECT node AS url, CASE WHEN node <> '/' THEN regexp_replace(regexp_replace(node, '/[^/]*$', ''), '^$', '/') END AS parent_url FROM {NODES})"

FIRST_NODES = f"(SELECT DISTINCT node, node = own AS leaf FROM (SELECT url AS own, unnest(list_transform(range(0, len(p) + 1), lambda n: '/' || array_to_string(p[1:n], '/'))) AS node FROM (SELECT url, list_filter(string_split(url, '/'), lambda s: s <> '') AS p FROM (SELECT DISTINCT url FROM ({PAGES_SQL}) ORDER BY url LIMIT 100))))"

ORACLE = {
    "dedupe_first": f"SELECT min(page_id) AS page_id, url FROM ({PAGES_SQL}) GROUP BY url",
    "link_semi_join": f"SELECT src_url, dst_url, page_id, pos FROM {E_} WHERE dst_url IN (SELECT url FROM {T_})",
    "incoming_links": f"SELECT t.url, count(DISTINCT e.src_url) AS incoming_links FROM {T_} t LEFT JOIN {E_} e ON e.dst_url = t.url GROUP BY t.url",
    "anchor_rollup": f"""WITH n AS (SELECT src_url, dst_url, page_id, pos, lower({BLANK.format(x='anchor_text')}) AS x FROM {E_}), a AS (SELECT *, CASE WHEN length(x) < 3 OR x IN ('here', 'click', 'click here', 'read more', 'link', 'this', 'more') THEN '' ELSE left(x, 100) END AS anchor FROM n),
one AS (SELECT src_url, dst_url, arg_min(anchor, (page_id, pos)) AS anchor FROM a WHERE anchor <> '' GROUP BY ALL), u AS (SELECT dst_url, anchor, min(src_url) AS src_url FROM one GROUP BY ALL),
c AS (SELECT *, sum(length(anchor) + 1) OVER (PARTITION BY dst_url ORDER BY src_url, anchor ROWS UNBOUNDED PRECEDING) - 1 AS total FROM u)
SELECT dst_url AS url, string_agg(anchor, ' ' ORDER BY src_url, anchor) AS anchor_text FROM c WHERE total <= 500 GROUP BY dst_url""",
    "graph_bfs_reach": f"WITH RECURSIVE e AS (SELECT parent_url, url FROM {TREE}), r AS (SELECT '/' AS url, 0 AS depth UNION ALL SELECT e.url, r.depth + 1 FROM r JOIN e ON e.parent_url = r.url WHERE r.depth < 4) SELECT url, min(depth) AS depth FROM r GROUP BY url",
    "site_tree": f"SELECT t.url, t.parent_url, len(list_filter(string_split(t.url, '/'), lambda s: s <> ''))::INTEGER AS depth, coalesce((SELECT max(title) FROM ({PAGES_SQL}) p WHERE p.url = t.url), '') AS title, EXISTS (SELECT 1 FROM ({PAGES_SQL}) p WHERE p.url = t.url) AS is_indexed, (SELECT count(*) FROM {TREE} c WHERE c.parent_url = t.url) AS child_count FROM {TREE} t",
    "site_structure": f"WITH n AS (SELECT node AS url, bool_or(leaf) AS is_indexed FROM {FIRST_NODES} GROUP BY node) SELECT url, is_indexed, (SELECT count(*) FROM n c WHERE c.url <> '/' AND regexp_replace(regexp_replace(c.url, '/[^/]*$', ''), '^$', '/') = n.url) AS child_count FROM n",
    "changed_pages": f"SELECT a.doc_id FROM {CURRENT} a LEFT JOIN {STORED} b ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.content_hash <> b.content_hash",
    "stale_pages": f"SELECT doc_id FROM {STORED} WHERE NOT custom AND doc_id NOT IN (SELECT doc_id FROM {CURRENT})",
    "stale_chunks": f"SELECT doc_id FROM {STORED} WHERE doc_id NOT IN (SELECT doc_id FROM {CURRENT})",
    "run_stats": f"SELECT status, count(*) AS n FROM {CLASSES} GROUP BY status",
    "deletion_ratio": f"SELECT round(avg((status = 'stale')::INTEGER), 9) AS ratio, avg((status = 'stale')::INTEGER) <= 0.5 AS eligible FROM {CLASSES} WHERE status <> 'new'",
    "collision_ordinal": "WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) - 1 AS nth FROM l",
    "scope_inventory": f"SELECT scope_name, count(*) AS documents, coalesce(max(read_at), 'unknown') AS last_indexed_at FROM {STORED_DOCS} WHERE project_id = 'en' GROUP BY scope_name",
    "hash_manifest": f"SELECT * FROM {STORED}",
    "legacy_scan": f"SELECT kind, count(*) AS n FROM {STORED_DOCS} WHERE project_id = 'en' AND legacy GROUP BY kind",
    "legacy_delete": f"SELECT doc_id FROM {STORED_DOCS} WHERE NOT (project_id = 'en' AND legacy)",
    "page_markdown": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS markdown FROM conversations GROUP BY conv_id",
    "list_pages": f"SELECT min(page_id) AS page_id, url FROM ({PAGES_SQL}) WHERE url > '/en/5' GROUP BY url ORDER BY url LIMIT 50",
    "limit_max_pages": f"SELECT url, page_id FROM ({PAGES_SQL}) ORDER BY url, page_id LIMIT 100",
    "llms_txt_lines": f"SELECT row_number() OVER (ORDER BY depth, incoming_links DESC, url, page_id) AS nth, '- [' || title || '](' || url || ')' AS line FROM {H_}",
    "prune_scopes": "SELECT 'u' || user_id AS scope_name FROM events GROUP BY user_id HAVING user_id NOT IN (1, 2, 3) AND 1800000000000 - max(epoch_ms(ts)) > 86400000",
    "boost_rank": f"SELECT page_id, round(final, 6) AS final FROM {B_}",
    "score_breakdown": f"SELECT page_id, round(base, 6) AS base, round(link_boost, 6) AS link_boost, round(depth_boost, 6) AS depth_boost, round(title_boost, 6) AS title_boost, round(final, 6) AS final FROM {B_}",
    "topk_rank": f"SELECT page_id, round(final, 6) AS final_score FROM {B_} ORDER BY final DESC, url || '#' || page_id LIMIT 20",
    "min_score_ratio": f"SELECT qid, page_id FROM (SELECT *, max(final_score) OVER (PARTITION BY qid) AS top FROM {RUN_}) WHERE top <= 0 OR final_score >= top * 0.7::DOUBLE",
    "chunk_mode_rank": f"SELECT qid, page_id, final_score FROM (SELECT *, max(final_score) OVER (PARTITION BY qid) AS top FROM {RUN_}) WHERE top <= 0 OR final_score >= top * 0.9::DOUBLE",
    "score_gap_trim": f"WITH k AS (SELECT * FROM (SELECT *, max(final_score) OVER (PARTITION BY qid) AS top FROM {RUN_}) WHERE top <= 0 OR final_score >= top * 0.1::DOUBLE), g AS (SELECT *, lag(final_score) OVER (PARTITION BY qid ORDER BY final_score DESC, url) AS p FROM k), c AS (SELECT *, max(CASE WHEN p > 0 AND (p - final_score) / p >= 0.02::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY final_score DESC, url ROWS UNBOUNDED PRECEDING) AS cut FROM g) SELECT qid, page_id FROM c WHERE cut = 0",
    "knn_cosine": f"SELECT qid, vec_id, score FROM {JUDGED} WHERE rank <= 10",
    "related_pages": f"""WITH p AS (SELECT page_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM ({PAGES_SQL})) WHERE n = 1), f AS (SELECT page_id, url FROM p ORDER BY page_id LIMIT 1),
e AS (SELECT a.url AS src, b.url AS dst FROM p a JOIN p b ON b.page_id = a.page_id // 2), v AS (SELECT p.url, m.embedding FROM p JOIN embeddings m ON m.vec_id = p.page_id),
near AS (SELECT a.url, {COS_EXACT} AS semantic FROM v a, v q WHERE q.url = (SELECT url FROM f) AND a.url <> q.url ORDER BY 2 DESC, 1 LIMIT 50),
c AS (SELECT p.url, p.title, n.semantic, EXISTS (SELECT 1 FROM e WHERE e.src = (SELECT url FROM f) AND e.dst = p.url) AS o, EXISTS (SELECT 1 FROM e WHERE e.dst = (SELECT url FROM f) AND e.src = p.url) AS i FROM p LEFT JOIN near n ON n.url = p.url WHERE p.url <> (SELECT url FROM f)),
z AS (SELECT *, list_filter(string_split(url, '/'), lambda s: s <> '') AS a, list_filter(string_split((SELECT url FROM f), '/'), lambda s: s <> '') AS b FROM c WHERE semantic IS NOT NULL OR o),
k AS (SELECT *, CASE WHEN len(a) + len(b) = 0 THEN 1::DOUBLE ELSE 2::DOUBLE * coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 2), lambda j: a[j] IS DISTINCT FROM b[j] OR a[j] IS NULL), true) - 1, 0) / (len(a) + len(b)) END AS dice FROM z)
SELECT url, title, round(0.5::DOUBLE * (o OR i)::INTEGER + 0.3::DOUBLE * dice + 0.2::DOUBLE * coalesce(semantic, 0), 6) AS score, CASE WHEN o THEN 'outgoing' WHEN i THEN 'incoming' WHEN dice > 0.4 THEN 'sibling' ELSE 'semantic' END AS kind FROM k ORDER BY score DESC, url LIMIT 25""",
    "mrr": f"SELECT round(avg(rr), 9) AS mrr FROM (SELECT qid, coalesce(1::DOUBLE / min(CASE WHEN relevance > 0 THEN rank END), 0) AS rr FROM {JUDGED} GROUP BY qid)",
    "precision_at_k": f"SELECT qid, round(sum(CASE WHEN rank <= 5 AND relevance > 0 THEN 1 ELSE 0 END) / 5::DOUBLE, 9) AS precision FROM {JUDGED} GROUP BY qid",
    "ndcg_at_k": f"WITH j AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank) AS ideal FROM {JUDGED}), s AS (SELECT qid, sum(CASE WHEN rank <= 5 THEN (2::DOUBLE ** relevance - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN (2::DOUBLE ** relevance - 1) / log2(ideal + 1) ELSE 0 END) AS idcg FROM j GROUP BY qid) SELECT qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 9) AS ndcg FROM s",
    "quality_assertions": f"""WITH p AS (SELECT qid, count(*) AS n, list(vec_id ORDER BY rank) AS v FROM {JUDGED} GROUP BY qid)
SELECT qid, 'top_result' AS kind, qid % 40 = 0 AS passed FROM p UNION ALL SELECT qid, 'in_top_5', qid % 60 = 0 FROM p UNION ALL SELECT qid, 'max_results', qid % 40 = 0 FROM p WHERE qid % 60 <> 0""",
    "public_results": f"SELECT page_id, url, depth::INTEGER AS depth, title || '|' || title AS chunks FROM {H_}",
}
ORACLE["site_subtree"] = f"SELECT * FROM ({ORACLE['site_tree']}) WHERE url = '/en' OR url LIKE '/en/%'"
