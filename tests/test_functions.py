import pytest
from pyspark.sql import functions as F

from sitewright.functions import chunking, html
from sitewright.functions import patterns as P
from sitewright.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("a,b,want", [("/", "/", 1), ("/docs/auth", "/blog/post", 0), ("/docs/auth", "/docs/sessions", 0.5), ("/docs", "/docs/auth", 2 / 3), ("/", "/docs/auth/login", 0), ("/a/b/c", "/a/b/d", 4 / 6)])
def test_dice_path(spark, a, b, want):
    assert one(spark, S.dice_path(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("raw,want", [("docs//a/", "/docs/a"), ("", "/"), ("/", "/"), (" /x ", "/x"), ("//", "/")])
def test_normalize_url_path(spark, raw, want):
    assert one(spark, S.normalize_url_path(F.lit(raw))) == want


@pytest.mark.parametrize("url,pattern,want", [("/docs", "/docs/**", True), ("/docs/a/b", "/docs/**", True), ("/docsx", "/docs/**", False), ("/docs/a", "/docs/*", True), ("/docs/a/b", "/docs/*", False), ("/docs", "/docs/*", False), ("/a", "/*", True), ("/a/b", "/*", False), ("/", "/**", True), ("/a/", "/a", True)])
def test_patterns(spark, url, pattern, want):
    assert one(spark, P.matches(F.lit(url), pattern)) is want


def test_robots(spark):
    rules = P.parse_robots("User-agent: *\nDisallow: /private/ # x\nAllow: /private/public-page\nUser-agent: mine\nDisallow: /mine\n", "other")
    assert one(spark, P.blocked_by_robots(F.lit("/private/a"), rules)) and not one(spark, P.blocked_by_robots(F.lit("/private/public-page"), rules))
    assert P.parse_robots("User-agent: *\nDisallow: /a\nUser-agent: mine\nDisallow: /mine\n", "mine").disallow == ("/mine",)


def test_chunk_keys_differ(spark):
    key = lambda u, h: one(spark, S.chunk_key(F.lit(u), F.array(*map(F.lit, h)), F.lit("t"), F.lit(0)))
    assert key("/a|b", ["c"]) != key("/a", ["b|c"])
    assert key("/a", ["a > b"]) != key("/a", ["a", "b"])
    assert key("/a", [" A "]) == key("/a", ["a"])


def test_snippet_and_anchor(spark):
    assert one(spark, S.snippet(F.lit("x" * 300))) == "x" * 219 + "…"
    assert one(spark, S.normalize_anchor(F.lit(" Installation  Guide "))) == "installation guide"
    assert one(spark, S.normalize_anchor(F.lit("Click here"))) == ""


def test_extract_recovers_and_reports():
    page = html.extract("https://a.b/x", '<title>T</title><body><nav><a href="/n">n</a></nav><main><h1>Head</h1><p>One <b>two<p>three <a href="/y/">why</a><img alt="logo"></main>')
    assert page["status"] == "indexed" and page["title"] == "Head"
    assert page["links"] == [{"url": "/y", "anchor_text": "why"}]
    assert "# Head" in page["markdown"] and "logo" not in page["markdown"]
    assert html.extract("/x", '<meta name="robots" content="NOINDEX, follow"><p>x')["status"] == "excluded"
    assert html.extract("/x", "<body> </body>")["status"] == "failed"
    assert html.extract("/x", None)["status"] == "failed"


def test_sections_and_chunks():
    text = "intro\n\n# A\n\nx\n\n```\n# not a heading\n```\n\n## B\n\ny\n"
    assert [s["title"] for s in chunking.sections(text)] == [None, "A", "B"]
    assert chunking.sections(text)[2]["path"] == ["A", "B"]
    long = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(20))
    got = chunking.split_section(long)
    assert all(len(c) <= 1500 for c in got) and len(got) > 3
    assert chunking.split_section(long) == got
    assert len(chunking.excerpt("a " * 400 + "needle " + "b " * 400, "needle")) < 300


@pytest.mark.parametrize("file,url", [("src/routes/+page.svelte", "/"), ("src/routes/docs/[id]/+page.svelte", "/docs/7"), ("src/routes/(app)/a/[...rest]/+page.svelte", "/a/b/c")])
def test_routes(spark, file, url):
    assert one(spark, P.route_for(F.lit(url), [file, "src/routes/zz/+page.svelte"])["resolution"]) == "exact"
