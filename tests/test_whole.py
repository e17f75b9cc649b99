"""Queries over all of their rows, on tables larger than any former limit."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.operators import ranking as R


def test_llms_txt_lists_every_page(spark):
    from sitewright.plans import registry
    from sitewright.plans.relational_queries import _hits

    sf = "/root/testdata/sf0.1"  # more pages than 500
    pages = sorted(_hits(spark, sf).collect(), key=lambda r: (r.depth, -r.incoming_links, r.url, r.page_id))
    got = {r.nth: r.line for r in registry.queries()["llms_txt_lines"](spark, sf).collect()}
    assert len(pages) > 500 and got == {i + 1: f"- [{r.title}]({r.url})" for i, r in enumerate(pages)}


@pytest.mark.parametrize("rows_per_part", [1, 7, 1000])
def test_numbered(spark, rows_per_part):
    rows = [(i % 3, None if i % 10 == 0 else f"u{i * 37 % 50}", i) for i in range(300)]
    frame = spark.createDataFrame(rows, "a int, b string, c long").repartition(5)
    got = R.numbered(frame, F.struct("a", "b", "c"), rows_per_part=rows_per_part).collect()
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    assert [(r.a, r.b, r.c) for r in sorted(got, key=lambda r: r.nth)] == want and sorted(r.nth for r in got) == list(range(1, 301))
    assert R.numbered(frame.limit(0), F.struct("a", "b", "c")).count() == 0


def test_hybrid_search_is_brute_force(spark, tmp_path):
    from sitewright.plans import registry

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(80)]
    docs = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))) for i in range(120)} | {120: "", 121: None}
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(6)) for i in range(61)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = defaultdict(list)
    for r in registry.queries()["hybrid_search"](spark, str(tmp_path)).orderBy("qid", "rank").collect():
        got[r.qid].append(r.score)
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def vector(text):
        v = np.zeros(64)
        for w in text.split():
            v[hashes[w] % 64] += 1 if hashes[w] // 64 % 2 == 0 else -1
        return v / np.linalg.norm(v) if v.any() else None

    words = {i: (t or "").split() for i, t in docs.items()}
    n, mean = len(docs), spark.createDataFrame(list(docs.items()), "i long, t string").selectExpr("avg(size(filter(split(lower(t), '[^a-z0-9]+'), x -> x <> '')))").first()[0]
    df = Counter(w for ws in words.values() for w in set(ws))

    def scaled(scores):
        m, dev = np.mean(list(scores.values())), np.std(list(scores.values()))
        return {i: min(1.0, max(0.0, (x - (m - 3 * dev)) / (6 * dev))) for i, x in scores.items()}

    assert sorted(got) == [0, 20, 40, 60]
    for qid, scores in got.items():
        sparse = {i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(items[qid].split()) & set(ws)) for i, ws in words.items() if set(ws) & set(items[qid].split())}
        dense = {i: float(v @ vector(items[qid])) for i, t in docs.items() if t and (v := vector(t)) is not None}
        a, b = scaled(sparse), scaled(dense)
        want = sorted(((a.get(i, 0) + b.get(i, 0)) / 2 for i in a.keys() | b.keys()), reverse=True)[:10]
        assert np.allclose(scores, want, atol=2e-6)
