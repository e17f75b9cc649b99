from sitewright.operators import diff, links as L, ranking as R, retrieval
from sitewright.operators.index import Hooks, Index
from sitewright.streaming import watch as W


def test_gap_trim_is_against_the_previous_row(spark):
    rows = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.8), ("q", "c", 0.4), ("q", "d", 0.39)], "qid string, url string, final_score double")
    kept = R.trim(rows, R.Boosts(min_score_ratio=0.1, score_gap=0.4))
    assert sorted(r.url for r in kept.collect()) == ["a", "b"]


def test_scores_are_never_nan(spark):
    bad = [float("nan"), float("inf"), float("-inf"), -1.0, None]
    rows = spark.createDataFrame([(s, x) for s in bad for x in bad], "score double, links double")
    from pyspark.sql import functions as F

    parts = R.boosted(F.col("score"), F.col("links"), F.col("links"), F.lit("t"), F.lit("t"))
    finals = [r.f for r in rows.select(parts["final"].alias("f")).collect()]
    assert len(finals) == 25 and all(f == f and f != float("inf") for f in finals)


def test_gate():
    assert diff.deletion_gate(10, 5, 5).eligible
    assert not diff.deletion_gate(10, 6, 4).eligible
    assert not diff.deletion_gate(10, 0, 0).eligible
    assert not diff.deletion_gate(10, 1, 9, ("truncated",)).eligible


def test_anchor_list_ends_at_the_first_that_does_not_fit(spark):
    rows = [("/a", "/t", "x" * 90, 0), ("/b", "/t", "y" * 90, 0), ("/c", "/t", "zzz", 0)]
    got = L.anchor_rollup(spark.createDataFrame(rows, "src_url string, dst_url string, anchor_text string, pos int"), length=100).first()
    assert got.anchor_text == "x" * 90


def test_tree_has_implied_parents(spark):
    rows = L.site_tree(spark.createDataFrame([("/blog/post-1", "1"), ("/blog/post-2", "2")], "url string, title string")).collect()
    blog = next(r for r in rows if r.url == "/blog")
    assert not blog.is_indexed and blog.child_count == 2 and blog.parent_url == "/"


def page(body):
    return f"<title>t</title><main><h1>t</h1><p>{body}</p></main>"


def test_index_runs(spark, tmp_path):
    index = Index(spark, str(tmp_path), "p", "main")
    frame = lambda d: spark.createDataFrame([(u, h) for u, h in d.items()], "url string, html string")
    first = {f"https://a.b/{i}": page(f"orbit {i}") for i in range(4)}
    assert index.run(frame(first)).status == {"new": 4}
    assert index.run(frame(first)).status == {"same": 4}
    less = {k: v for k, v in first.items() if not k.endswith("3")}
    stats = index.run(frame(less), warnings=("truncated",))
    assert stats.deleted == 0 and index.read().count() == 4
    assert index.run(frame(less)).deleted == 1 and index.read().count() == 3
    stats = index.run(frame({k: less[k] for k in list(less)[:1]}))
    assert not stats.gate.eligible and index.read().count() == 3
    assert index.read("chunks").filter("text LIKE '%orbit 1%'").count() == 1


def test_rate_limit(spark):
    rows = [("k", t) for t in (0, 1, 2, 60_000)]
    got = W.rate_limit(spark.createDataFrame(rows, "k string, t long"), "k", "t", most=2).orderBy("t").collect()
    assert [r.allowed for r in got] == [True, True, False, True]


def test_watch(spark, tmp_path):
    seen = []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    query = W.watch(spark, str(tmp_path / "in"), "id long", lambda b: seen.append(b.count()), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sum(seen) == 3


def test_custom_records_and_hooks(spark, tmp_path):
    index, seen = Index(spark, str(tmp_path), "p", "main"), []
    source = spark.createDataFrame([(f"https://a.b/{i}", page(f"orbit {i}")) for i in range(5)], "url string, html string")
    schema = "url string, title string, content string, tags array<string>, weight double"
    records = spark.createDataFrame([("/c/1/", "own", "words", ["t"], None)], schema)
    hooks = Hooks(transform_page=lambda p: p.filter("url <> '/4'"), after_index=lambda s: seen.append(s.status))
    assert index.run(source, custom=records, hooks=hooks).status == {"new": 5} and seen == [{"new": 5}]
    assert [(r.url, r.tags) for r in index.read().filter("custom").collect()] == [("/c/1", ["c", "t"])]
    # None says nothing of custom pages
    assert index.run(source, hooks=hooks).deleted == 0 and index.read().filter("custom").count() == 1
    # an empty record is a warning and no deletion
    blank = spark.createDataFrame([("/c/1", "own", " ", None, None)], schema)
    assert not index.run(source, custom=blank, hooks=hooks).gate.eligible and index.read().filter("custom").count() == 1
    assert index.run(source, custom=records.limit(0), hooks=hooks).deleted == 1 and index.read().filter("custom").isEmpty()


def test_fetch_keeps_scopes_apart(spark):
    pages = spark.createDataFrame([("/a",), ("/b",)], "url string")
    asked = spark.createDataFrame([("ss:1:p:main:page:%2Fa",), ("ss:1:p:other:page:%2Fb",), (None,)], "id string")
    assert [r.url for r in retrieval.fetch(pages, asked, "p", "main").collect()] == ["/a"]


def test_remote_branches():
    assert diff.remote_branches("  'origin/main'\norigin\n origin/HEAD\nup/feat/x\n", ["origin", "up"]) == {"main", "feat/x"}
    assert diff.remote_branches("origin\n", ["origin"]) is None and diff.remote_branches("origin/a", []) is None
