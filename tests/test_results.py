import pytest

from sitewright.functions import chunking, components, markdown as M, results as V
from pyspark.sql import functions as F


def plainly(text, query, length):
    """The excerpt by trying every stretch."""
    if len(text) <= length:
        return text
    words = [w for w in query.lower().split() if len(w) > 1]
    hits = []
    for k, w in enumerate(words):
        i = text.lower().find(w)
        while i >= 0:
            hits.append((i, i + len(w), k))
            i = text.lower().find(w, i + len(w))
    hits.sort(key=lambda h: h[0])
    best = None
    for b in range(len(hits)):
        a = next(a for a in range(b + 1) if a == b or hits[b][1] - hits[a][0] <= length)
        score = (len({h[2] for h in hits[a : b + 1]}), b - a + 1)
        if best is None or score > best[0]:
            best = (score, (hits[a][0] + hits[b][1]) // 2)
    return best and best[1]


def test_excerpt():
    text = " ".join(f"word{i % 37} gap" for i in range(200)) + " zebra apple " + "tail " * 100
    got = chunking.excerpt(text, "Zebra APPLE x word3", 60)
    assert "zebra apple" in got and got.startswith("…") and got.endswith("…") and len(got) <= 72 + 2
    for query in ("word3 word4", "gap", "zebra word36 tail", "apple"):
        shown = chunking.excerpt(text, query, 80)
        middle = plainly(text, query, 80)
        assert text[max(0, middle - 5) : middle + 5].strip() in shown
    assert chunking.excerpt("short", "q") == "short"
    assert chunking.excerpt("a" * 300, "none").endswith("…") and len(chunking.excerpt("a" * 300, "none")) == 220
    assert chunking.excerpt("x" * 500 + " hit", "hit", 50).endswith("hit")


def test_first_paragraph():
    assert chunking.first_paragraph("# T\n\n```\ncode\n```\n one\ntwo\n\nthree") == "one two"
    assert chunking.first_paragraph("```\nopen\n") == "" and chunking.first_paragraph("") == ""


def test_front_matter():
    page = M.extract("/docs/a", "---\ntitle: T\nkeywords: a, b,,\nupdatedAt: 2024-01-02T00:00:00Z\nsearch:\n  weight: 0.5\n  meta: {n: 1, 'bad key': x, l: [a, b], t: true}\n---\nBody  \n")
    assert page["status"] == "indexed" and page["title"] == "T" and page["keywords"] == ["a", "b"] and page["tags"] == ["docs"]
    assert page["weight"] == 0.5 and page["published_ms"] == 1704153600000 and page["meta"] == {"n": "1", "l": "a,b", "t": "true"} and page["markdown"] == "Body\n"
    assert M.extract("/a", "```\n<!-- noindex -->\n```\nx")["status"] == "indexed"
    assert M.extract("/a", "x\n<!-- NoIndex -->")["reason"] == "noindex"
    assert M.extract("/a", "---\nnoindex: true\n---\nx")["reason"] == "noindex"
    assert M.extract("/a", "---\n: [\n---\nx")["markdown"] == "x\n"
    for empty in (None, "", "---\ntitle: x\n---\n", " \n"):
        assert M.extract("/a", empty)["status"] == "failed"


def test_components():
    told = components.describe("<!-- @component\n Hi --><script>type P = { a?: string; b: { c: number } }\nlet { a = '{,}', b, ...r }: P = $props()</script>")
    assert told == {"description": "Hi", "props": [{"name": "a", "type": "string", "default": "'{,}'"}, {"name": "b", "type": "{ c: number }", "default": None}]}
    assert components.describe(None) == {"description": None, "props": []}
    assert components.page_text("x/+layout@app.svelte", "<p>a {b}</p>") == ("a", False)


def test_results(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    null = lit(None).cast("string")
    assert get(V.result_url(lit("/a?x=1#h:~:text=old"), lit("Set up"), lit("How to set up… it all"))) == "/a?x=1&_ssk=Set+up&_sskt=How+to+set+up+it+all#h:~:text=How%20to%20set%20up%20it%20all"
    assert get(V.result_url(lit("/a"), lit("Title"), lit("other words"))) == "/a?_ssk=Title&_sskt=Title#:~:text=Title"
    assert get(V.result_url(lit("/a"), null, null)) == "/a"
    assert get(V.breadcrumb(lit("https://x.y/docs/getting-started.html?q#f"))) == "Docs / Getting Started"
    assert get(V.breadcrumb(lit("/"))) == "" and get(V.breadcrumb(lit("/a%zz/index.html"))) == "A%Zz"
    assert get(V.section_label(lit("T"), lit(" t "))) is None
    parts = get(V.highlight_parts(lit("Deploy the (x) deployment"), lit("deploy (x)")))
    assert [(p.text, p.match) for p in parts] == [("Deploy", True), (" the ", False), ("(x)", True), (" ", False), ("deploy", True), ("ment", False)]


@pytest.mark.parametrize("name", ["excerpt"])
def test_rows(spark, name):
    from sitewright.plans import registry

    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
