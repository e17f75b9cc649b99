"""Searches, filters, stored chunks, the index's commits, sources and lists, on small cases."""

import gzip

import pytest
from pyspark.sql import functions as F

from sitewright.functions import chunking, html
from sitewright.functions import patterns as P
from sitewright.functions import scalars as S
from sitewright.operators import index as I, pages as G, ranking as R, retrieval, search as H
from sitewright.sources import readers
from sitewright.streaming import watch as W


def page(title, body):
    return f"<title>{title}</title><main><h1>{title}</h1>{body}</main>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_requests_are_checked():
    for bad in ({"top_k": 0}, {"top_k": 101}, {"sub_results": 21}, {"by": "word"}):
        with pytest.raises(H.InvalidRequest):
            H.Request(**bad)
    assert H.overridden(R.Boosts(), {"depth": 9.0}, debug=False) == R.Boosts() and H.overridden(R.Boosts(), {"depth": 9.0}, debug=True).depth == 9.0
    with pytest.raises(H.InvalidRequest):
        H.overridden(R.Boosts(), {"no such": 1.0}, debug=True)
    assert H.allowed_scope(None, "main", []) == "main" and H.allowed_scope("dev", "main", ["dev"]) == "dev"
    with pytest.raises(PermissionError):
        H.allowed_scope("dev", "main", [])


def test_filters(spark):
    rows = spark.createDataFrame([("/docs/a", ["x", "y"]), ("/doc", ["x"]), ("/blog", None)], "url string, tags array<string>")
    assert sorted(r.url for r in rows.filter(H.below(F.col("url"), "doc")).collect()) == ["/doc", "/docs/a"]
    assert [r.url for r in rows.filter(H.has_tags(F.col("tags"), ("y", "x"))).collect()] == ["/docs/a"]
    assert rows.filter(H.has_tags(F.col("tags"), ())).count() == 3
    meta = F.create_map(*[x for k, kind, raw in (("n", "number", "2"), ("t", "boolean", "true"), ("s", "string", "abc"), ("l", "string[]", "a, b")) for x in (F.lit(k), S.meta_value(F.lit(kind), F.lit(raw)))])
    holds = lambda f: one(spark, H.meta_matches(meta, f))
    assert holds({"n": 2, "t": True, "s": "abc", "l": "b", "not a key": "z"})
    assert not holds({"n": 3}) and not holds({"t": False}) and not holds({"s": "ab"}) and not holds({"l": "c"}) and not holds({"none": "x"})
    with pytest.raises(H.InvalidRequest):
        holds({"s": "x' OR 1"})


def _site(spark):
    pages = [("/a", "Alpha guide", 3, 1, ["docs"], "about alpha"), ("/a/b", "Beta", 0, 2, ["docs"], None), ("/c", "Gamma", 0, 1, ["blog"], ""), ("/d", "Delta", 0, 1, ["docs"], None)]
    chunks = [("/a#0", "/a", "Intro", ["Intro"], "alpha beta gamma", ["docs"]), ("/a#1", "/a", "More", ["More"], "alpha again", ["docs"]), ("/c#0", "/c", None, [], "gamma alone", ["blog"])]
    return (
        spark.createDataFrame(pages, "url string, title string, incoming_links int, depth int, tags array<string>, description string").withColumn("route_file", F.lit("src/x")),
        spark.createDataFrame(chunks, "chunk_key string, url string, section string, path array<string>, text string, tags array<string>"),
        spark.createDataFrame([(1, "alpha")], "qid int, query string"),
    )


def test_search_shows_pages_with_their_sections(spark):
    pages, chunks, asked = _site(spark)
    scores = spark.createDataFrame([(1, "/a", 0.8), (1, "/c", 0.9), (1, "/a/b", 0.75), (1, "/d", 0.1)], "qid int, url string, score double")
    found = H.ranked(scores, pages, asked)
    assert [r.url for r in found.orderBy("rank").collect()] == ["/a", "/c", "/a/b"]  # the title's boost; /d is far below
    near = spark.createDataFrame([(1, "/a#0", 0.3), (1, "/a#1", 0.6), (1, "/c#0", 0.2)], "qid int, chunk_key string, score double")
    shown = {r.url: r for r in H.results(found, near, chunks, H.Request(sub_results=1)).collect()}
    assert shown["/a"].section_title == "More" and shown["/a"].snippet == "alpha again" and len(shown["/a"].chunks) == 1 and shown["/a"].chunks[0].score == 0.6
    assert shown["/a/b"].snippet == "Beta" and shown["/a/b"].chunks is None and shown["/c"].section_title is None
    told = H.public(H.results(found, near, chunks))
    assert not {"route_file", "chunk_text"} & set(told.columns) and "chunk_text" not in told.schema["chunks"].dataType.elementType.names
    only = H.ranked(scores, pages, asked, H.Request(tags=("blog",)))
    assert [r.url for r in only.collect()] == ["/c"]
    weighed = H.ranked(scores, pages, asked, weight=P.weight_for(F.col("url"), {"/a": 0.0, "/a/b": 3.0}))
    assert [r.url for r in weighed.orderBy("rank").collect()] == ["/a/b"]  # 0 drops /a, and the gap below 3 x drops /c


def test_chunk_snippets(spark):
    rows = spark.createDataFrame([("needle", "a " * 200 + "needle", "s"), ("", "t" * 40, "stored " * 6), (None, "text", "short"), (None, None, None)], "query string, text string, snippet string")
    shown = [r.shown for r in H.chunk_snippet(rows).collect()]
    assert shown[0].endswith("needle") and shown[1] == "stored " * 6 and shown[2] == "text" and shown[3] == ""


def test_related_pages(spark):
    urls = ["/docs/a", "/docs/b", "/blog/c", "/docs/d", "/x"]
    pages = spark.createDataFrame([(u, u.upper()) for u in urls], "url string, title string")
    edges = spark.createDataFrame([("/docs/a", "/blog/c"), ("/x", "/docs/a"), ("/docs/a", "/gone"), ("/docs/a", "/docs/a")], "src_url string, dst_url string")
    vectors = spark.createDataFrame([(u, [1.0, float(k)]) for k, u in enumerate(urls)], "url string, v array<double>")
    got = {r.url: (r.kind, r.score) for r in H.related_pages("/docs/a", pages, edges, vectors).collect()}
    assert {u: k for u, (k, _) in got.items()} == {"/docs/b": "sibling", "/docs/d": "sibling", "/blog/c": "outgoing", "/x": "incoming"}
    assert got["/docs/b"][1] == pytest.approx(0.3 * 0.5 + 0.2 / 2**0.5, abs=1e-6) and got["/blog/c"][1] == pytest.approx(0.5 + 0.2 / 5**0.5, abs=1e-6)
    assert H.related_pages("/none", pages, edges, vectors).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_dense_scores_are_cosines(spark, block):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v[7] = 0
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(99, None)], "id int, v array<double>")
    asked = frame.filter("id % 4 = 0").withColumnRenamed("id", "qid")
    got = {(r.qid, r.id): r.score for r in retrieval.dense(frame, asked, block).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    want = {(i, j): float(unit[i] @ unit[j]) for i in range(0, 40, 4) for j in range(40) if j != 7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stored_chunks_have_keys_that_survive_edits(spark):
    text = "# T\n\nintro\n\n## Same\n\nword\n\n## Same\n\nword\n\n## Last\n\nend\n"
    row = lambda m, meta=None, custom=False: spark.createDataFrame([("/p/x-y", "T", m, "", ["k1", "k2"], custom, meta)], "url string, title string, markdown string, description string, keywords array<string>, custom boolean, meta map<string,struct<kind:string,raw:string>>")
    chunks = G.index_chunks(row(text)).orderBy("ordinal").collect()
    assert [c.ordinal for c in chunks] == [0, 1, 2, 3, 4] and len({c.chunk_key for c in chunks}) == 5
    assert chunks[0].text == "T\n\np / x y\n\nk1, k2" and chunks[0].path == [] and [c.nth for c in chunks] == [0, 0, 0, 1, 0]
    edited = {c.chunk_key: c for c in G.index_chunks(row(text.replace("intro", "other words"))).collect()}
    assert sum(c.chunk_key in edited for c in chunks) == 4  # all but the edited one
    assert {c.content_hash for c in chunks}.isdisjoint(c.content_hash for c in G.index_chunks(row(text, custom=True)).collect())
    assert chunks[1].content_hash != {c.chunk_key: c for c in G.index_chunks(row(text, {"a": {"kind": "string", "raw": "1"}})).collect()}[chunks[1].chunk_key].content_hash
    plain = G.index_chunks(row(text), summary=False)
    assert plain.count() == 4 and G.reassembled(plain).first().markdown == "# T\n\nintro\n\n## Same\n\nword\n\n## Same\n\nword\n\n## Last\n\nend"
    assert one(spark, G.embedding_title(F.lit("T"), F.lit("s"), F.array(F.lit("a"), F.lit("b")))) == "T > a > b"


def test_chunks_are_cut_as_documented():
    assert chunking.split_section("a\n\n\n\nb") == ["a\n\n\n\nb"]  # what fits stays as it is
    assert chunking.cut_long("xxxxxxx yy zzzzzzzz", 10, 0) == ["xxxxxxx yy", "zzzzzzzz"]
    assert chunking.split_section("aaaa\n\nbbbb\n\ncccccc\n\ndd", most=10, least=3, overlap=0) == ["aaaa\n\nbbbb", "cccccc\n\ndd"]
    assert chunking.split_section("aaaa\n\nbbbbbbb\n\nc\n\ndddddddd", most=12, least=0, overlap=3) == ["aaaa", "aaa\n\nbbbbbbb", "bbb\n\nc", "c\n\ndddddddd"]
    table = "| a |\n| - |\n" + "| x |\n" * 50
    assert chunking.split_section("intro\n\n" + table, most=60) == ["intro", table.strip()]


def test_images_say_what_they_show():
    body = lambda x: html.extract("/x", f"<main>{x}</main>")["markdown"]
    assert body('<figure><img alt="A chart of sales"><figcaption>Sales 2020</figcaption></figure>') == "A chart of sales — Sales 2020\n"
    assert body('<figure><img alt="logo"><figcaption>Our sign</figcaption></figure>') == "Our sign\n"
    assert body('<figure data-search-description="Two lines"><img alt="chart.png"><figcaption>c</figcaption></figure>') == "Two lines\n"
    assert body('<p>x <img alt="photo.jpeg?w=3"> <img alt="avatar"> <img alt="A real picture"></p>') == "x   A real picture\n"
    assert body('<picture><source srcset="a"><img alt="A red boat"></picture>') == "A red boat\n"


def test_typed_meta():
    got = html.extract("/x", '<meta name="search:rank" content="3" data-type="number"><meta name="search:tags" content="a, b"><meta name="search:bad key" content="x"><p>t</p>')
    assert got["meta"] == {"rank": {"kind": "number", "raw": "3"}} and got["tags"] == ["x", "a", "b"]


def test_robots_groups_without_rules_fall_back():
    rules = P.parse_robots("User-agent: mine\nDisallow:\nUser-agent: *\nDisallow: /a\n", "mine")
    assert rules.disallow == ("/a",)


def test_rules_shape_a_run(spark, tmp_path):
    index = I.Index(spark, str(tmp_path), "p", "main")
    source = spark.createDataFrame([(f"https://a.b/{p}", page(p, f'<p>{p} text</p><a href="/docs/one">To the first</a>')) for p in ("docs/one", "docs/two", "private/x", "old/y", "zero/z")], "url string, html string")
    rules = I.Rules(exclude=("/old/**",), robots=P.RobotsRules(("/private/",)), weights={"/zero/**": 0.0}, routes=("src/routes/docs/[id]/+page.svelte",), summary_chunks=True)
    stats = index.run(source, rules=rules)
    pages = {r.url: r for r in index.read().collect()}
    assert stats.status == {"new": 2} and stats.excluded == 3 and set(pages) == {"/docs/one", "/docs/two"}
    assert pages["/docs/one"].incoming_links == 2 and pages["/docs/one"].anchor_text == "to the first" and pages["/docs/one"].route_file == rules.routes[0] and pages["/docs/one"].route_resolution == "exact"
    chunks = index.read("chunks")
    assert chunks.filter("ordinal = 0 AND size(path) = 0").count() == 2 and chunks.filter("chunk_key IS NULL OR content_hash IS NULL").count() == 0
    # an anchor text changes the page that it leads to, and no chunk of it
    again = source.withColumn("html", F.when(F.endswith("url", F.lit("two")), F.replace("html", F.lit("To the first"), F.lit("Somewhere else"))).otherwise(F.col("html")))
    stats = index.run(again, rules=rules)
    assert stats.status == {"changed": 2} and stats.chunk_status.get("new", 0) == 1
    assert index.hashes().columns == ["url", "content_hash", "custom"] and index.hashes("chunks").count() == chunks.count()


def test_a_run_that_dies_leaves_the_index_as_it_was(spark, tmp_path):
    index = I.Index(spark, str(tmp_path), "p", "main")
    source = lambda n: spark.createDataFrame([(f"https://a.b/{i}", page(f"t{i}", "<p>x</p>")) for i in range(n)], "url string, html string")
    index.run(source(3))

    def die(chunks):
        raise RuntimeError("no more")

    with pytest.raises(RuntimeError):
        index.run(source(2), accepted=True, hooks=I.Hooks(before_index=die))
    assert index.read().count() == 3 and index.read("chunks").count() == 3
    assert index.run(source(3)).status == {"same": 3}
    assert index.delete(spark.createDataFrame([("/1/",), ("/9",)], "url string")) == 1
    assert sorted(r.url for r in index.read().collect()) == ["/0", "/2"] and index.read("chunks").filter("url = '/1'").isEmpty()
    other = I.Index(spark, str(tmp_path), "p", "other")
    assert other.read() is None and other.delete(spark.createDataFrame([("/1",)], "url string")) == 0
    before = index.read().count()
    assert index.run(source(1), accepted=True, dry_run=True).deleted == 1 and index.read().count() == before
    index.drop()
    assert index.read() is None


def test_paging_loses_no_page(spark):
    pages = spark.createDataFrame([(f"/{i:03d}",) for i in range(130)], "url string")
    got, cursor = [], None
    while rows := [r.url for r in I.page_after(pages, cursor).collect()]:
        got, cursor = got + rows, rows[-1]
    assert got == [f"/{i:03d}" for i in range(130)]
    assert I.page_after(pages, limit=9999).count() == 130 and I.page_after(pages, limit=0).count() == 1 and I.page_after(pages, prefix="00").count() == 10
    first, more = readers.limited(pages, 5)
    assert [r.url for r in first.collect()] == got[:5] and more and not readers.limited(pages, 130)[1]


def test_static_folders(spark, tmp_path):
    root = tmp_path / "bu.ild+x"
    (root / "docs").mkdir(parents=True)
    (root / "index.html").write_text("home")
    (root / "docs" / "a.html").write_text("a")
    (root / "docs" / "b.md").write_text("# b")
    assert sorted((r.url, r.html) for r in readers.static_html(spark, str(root)).collect()) == [("/", "home"), ("/docs/a", "a")]
    assert [(r.url, r.markdown) for r in readers.content_files(spark, f"file://{root}/").collect()] == [("/docs/b", "# b")]


def test_sitemaps_lead_to_sitemaps(spark):
    urls = lambda *x: "<urlset>" + "".join(f"<url><loc>https://a.b{u}</loc></url>" for u in x) + "</urlset>"
    index = "<sitemapindex><sitemap><loc>https://a.b/1.xml.gz</loc></sitemap><sitemap><loc>https://a.b/2.xml</loc></sitemap><sitemap><loc>https://a.b/broken</loc></sitemap></sitemapindex>"
    files = {"https://a.b/sitemap.xml": index.encode(), "https://a.b/1.xml.gz": gzip.compress(urls("/x", "/y/").encode()), "https://a.b/2.xml": urls("/y", "/z").encode(), "https://a.b/broken": None}
    fetch = lambda asked: spark.createDataFrame([(u, files.get(u)) for u in asked], "url string, content binary")
    found, warnings = readers.sitemap_tree(fetch, ["https://a.b/sitemap.xml"])
    assert sorted(r.url for r in found.collect()) == ["/x", "/y", "/z"] and warnings == ["unreadable sitemap: https://a.b/broken"]
    found, warnings = readers.sitemap_tree(fetch, ["https://a.b/sitemap.xml"], most=2)
    assert sorted(r.url for r in found.collect()) == ["/x", "/y"] and warnings == ["sitemap limit reached"]


def test_lists_are_written_in_order(spark, tmp_path):
    pages = spark.createDataFrame([("/b", "B", None, 1, 0), ("/a", "A", "first", 1, 5), ("/llms.txt", "L", None, 1, 9), ("/", "Home", "", 0, 0)], "url string, title string, description string, depth int, incoming_links int")
    want = ["# Site", "", "## Pages", "", "- [Home](https://x.y/)", "- [A](https://x.y/a): first", "- [B](https://x.y/b)"]
    lines = readers.llms_txt(pages, "Site", base_url="https://x.y/")
    assert [r.line for r in lines.orderBy("nth").collect()] == want
    readers.write_lines(lines, str(tmp_path / "llms"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "llms").glob("part-*"))).splitlines() == want


def test_rate_limit_counts_all_keys(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000)) for _ in range(400)]
    want, state = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        opened, n = state.get(k, (None, 0))
        opened, n = (t, 1) if opened is None or t >= opened + 100 else (opened, n + 1)
        state[k] = opened, n
        want.append((k, t, n <= 3))
    got = [(r.k, r.t, r.allowed) for r in W.rate_limit(spark.createDataFrame(rows, "k string, t long"), "k", "t", most=3, window_ms=100).collect()]
    key = lambda r: (r[0] or "", r[1], not r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_small_numbers_and_urls(spark):
    assert [one(spark, S.clamp_int(F.lit(x).cast("double"), 1, 500, 90)) for x in (None, 0.0, 7.9, 1e9)] == [90, 1, 7, 500]
    assert one(spark, S.clamp_int(F.lit(float("nan")), 1, 500, 90)) == 90
    assert one(spark, S.join_url(F.lit("https://a.b//"), F.lit("x"))) == "https://a.b/x"


def test_discovery_follows_links_within_limits(spark):
    from sitewright.sources import site as D

    link = lambda *urls: "<p>x</p>" + "".join(f'<a href="{u}">l</a>' for u in urls)
    answers = {"/": link("/a", "/b/", "/img.png", "/gone"), "/a": link("/c", "/", "https://else.where/x"), "/b": link("/skip/me"), "/c": link("/d"), "/d": link("/e"), "/e": link(), "/skip/me": link()}
    rows = [(u, h, 200, "text/html; charset=utf-8") for u, h in answers.items()] + [("/img.png", "", 200, "image/png"), ("/bad", "", 500, "text/html")]
    frame = spark.createDataFrame(rows, "url string, html string, status int, content_type string")
    seeds = spark.createDataFrame([("/",), ("/bad/",)], "url string")
    found = D.discover(frame, seeds, exclude=("/skip/**",))
    assert {r.url: r.depth for r in found.pages.collect()} == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/d": 3, "/e": 4} and found.limited_by is None
    assert {r.url: r.reason for r in found.failures.collect()} == {"/bad": "500", "/gone": "no answer"}
    found = D.discover(frame, seeds, max_depth=2)
    assert found.limited_by == "max-depth" and found.pages.count() == 5
    found = D.discover(frame, seeds, max_pages=2)
    assert found.limited_by == "max-pages" and sorted(r.url for r in found.pages.collect()) == ["/", "/a"]
    found = D.discover(frame, seeds, max_pages=0)
    assert found.pages.count() == 0 and found.limited_by == "max-pages"


def test_where_a_site_is_built(spark, tmp_path):
    from sitewright.sources import site as D

    root = str(tmp_path)
    assert D.detect_output(spark, root) is None
    (tmp_path / "build" / "prerendered").mkdir(parents=True)
    (tmp_path / "build" / "index.html").write_text("x")
    assert D.detect_output(spark, root) == D.Output("static", "build")
    (tmp_path / "build" / "handler.js").write_text("x")
    assert D.detect_output(spark, root) == D.Output("node", "build/prerendered")
    assert D.robots_of(spark, root, "me") is None
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /a\n")
    assert D.robots_of(spark, root, "me").disallow == ("/a",)


def test_scopes_are_resolved():
    from sitewright.sources import site as D

    assert D.resolve_scope("p") == ("p", "main") and D.resolve_scope("p", asked="Feat/X y") == ("p", "feat-x-y")
    assert D.resolve_scope("p", mode="env", variable="V", environment={"V": "Dev"}) == ("p", "dev")
    assert D.resolve_scope("p", mode="git", folder="/", fixed="own") == ("p", "own")
    for bad in ({"project": "a:b"}, {"project": "p", "asked": "x y", "sanitize": False}, {"project": "p", "mode": "env", "variable": "none", "environment": {}}):
        with pytest.raises(ValueError):
            D.resolve_scope(**bad)


def test_subtree_of_a_path_that_is_not_there(spark):
    from sitewright.operators import links as L

    tree = L.site_tree(spark.createDataFrame([("/a/b", "B"), ("/ab", "x")], "url string, title string"))
    assert sorted(r.url for r in L.subtree(tree, "/a/").collect()) == ["/a", "/a/b"]
    none = L.subtree(tree, "z/y").collect()
    assert [(r.url, r.parent_url, r.depth, r.is_indexed, r.child_count) for r in none] == [("/z/y", "/z", 2, False, 0)]
    rows, more = L.site_structure(spark.createDataFrame([(f"/{i}", "t") for i in range(5)], "url string, title string"), most=3)
    assert more and sorted(r.url for r in rows.collect()) == ["/", "/0", "/1", "/2"]


def test_scroll_matches(spark):
    from sitewright.functions import results as V

    at = lambda text, needle: (r.start, r.end) if (r := one(spark, V.scroll_match(F.lit(text), F.lit(needle)))) else None
    assert at("How to Set - up it", "set up") == (7, 15)
    assert at("one setup", "set up") == (4, 9)
    assert at("c++ here", "++") == (1, 3) and at("abc", "x y") is None and at("abc", "") is None
    assert one(spark, V.wrap_index(F.lit(-1), F.lit(3))) == 2 and one(spark, V.wrap_index(F.lit(1), F.lit(0))) == -1


def test_json_and_ids(spark):
    assert one(spark, S.safe_json(F.lit("[1, 2]"), "array<int>", F.array(F.lit(0)))) == [1, 2]
    assert one(spark, S.safe_json(F.lit("{"), "array<int>", F.array(F.lit(0)))) == [0]
    ids = S.page_id(F.lit("p"), F.lit("main"), F.lit("/a b+c"))
    assert one(spark, S.url_of_page_id(ids, F.lit("p"), F.lit("main"))) == "/a b+c" and one(spark, S.url_of_page_id(ids, F.lit("p"), F.lit("other"))) is None
    with pytest.raises(ValueError):
        S.safe_literal("a'b")


def test_watched_folders_fill_an_index(spark, tmp_path):
    index = I.Index(spark, str(tmp_path / "index"), "p", "main")
    rows = lambda a, b: spark.createDataFrame([(f"https://a.b/{i}", page(f"t{i}", "<p>x</p>")) for i in range(a, b)], "url string, html string")
    rows(0, 3).write.parquet(str(tmp_path / "in"))
    W.watch_into(index, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination(120)
    assert index.read().count() == 3
    rows(2, 5).write.mode("append").parquet(str(tmp_path / "in"))
    W.watch_into(index, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination(120)
    assert index.read().count() == 5 and index.health() == (True, None)
