"""The registered queries over whole small tables, against plain code; and the pipeline over hard ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import decontaminate, pii, quality, registry, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2_fills_shards_evenly(spark, documents):
    rows = registry.op2_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r["size"] == len(documents[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(documents[r.doc_id].encode()) for r in rows)
    shards, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        shards[r.shard].append(r)
        of_text[documents[r.doc_id]].add(r.shard)
    assert sorted(shards) == list(range(16)) and all(len(s) == 1 for s in of_text.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    loads = [sum(r["size"] for r in s) for s in shards.values()]
    groups = Counter()
    for text in documents.values():
        groups[text] += len(text.encode()) + 1
    # no shard holds more than its share and the largest group that cannot be divided
    assert max(loads) <= max(sum(loads) / 16 * 1.01, max(groups.values()))


def test_op3_is_the_patterns(spark, documents):
    for r in registry.op3_pii(spark, SF).collect():
        text = documents[r.doc_id]
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]


def test_op5_is_the_library(spark, documents):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(registry.tokenizer_path())
    rows = {r.doc_id: r for r in registry.op5_bpe(spark, SF).collect()}
    assert rows.keys() == documents.keys()
    for i, text in documents.items():
        ids = reference.encode(text, add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op4_posteriors_are_bayes_rule(spark):
    rng = np.random.default_rng(4)
    table = rng.random((2, 3, 3)) + 0.1
    table[:, :, quality.NONE] = 1.0
    votes = np.array([[a, b, c] for a in range(3) for b in range(3) for c in range(3)])
    for v, got in zip(votes, quality.posterior(votes, 0.7, table), strict=True):
        likely = [np.prod([table[c][k][v[k]] for k in range(3)]) * p for c, p in ((quality.BAD, 0.3), (quality.GOOD, 0.7))]
        assert got == pytest.approx(likely[quality.GOOD] / sum(likely))


def test_op4_finds_the_accuracies_of_labellers(spark):
    """Votes drawn from known accuracies: expectation-maximisation comes back to them."""
    rng = np.random.default_rng(6)
    good = rng.random(40_000) < 0.8
    right, spoken = rng.uniform(0.75, 0.97, quality.LABELLERS), 0.7
    votes = np.where(rng.random((len(good), quality.LABELLERS)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) > spoken] = quality.NONE
    share, table = quality.estimate(Counter(map(tuple, votes.tolist())))
    assert share == pytest.approx(0.8, abs=0.02)
    assert np.abs(table[quality.GOOD][:, quality.GOOD] - right).max() < 0.05
    assert ((quality.posterior(votes, share, table) > 0.5) == good).mean() > 0.97


def test_op4_runs_agree_and_a_hot_text_is_drawn_once(spark):
    words = [f"word{i}" for i in range(300)]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + ".") for i in range(150)] + [(1000 + i, "The same page again and again. " * 5) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (quality.fit(docs.repartition(n), sample=50) for n in (2, 5))
    assert np.allclose(one[2], two[2]) and np.allclose(one[1], two[1])


def test_op10_never_learns_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert a == b and {i: h for i, (_, _, h) in a.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in a}


def plain_windows(text):
    """Template windows of a text, read as written and with sentence-initial names, in plain code."""
    text = re.sub(r"\s{2,}|[^\S ]", " ", text)
    text = re.sub(rf"(?i)[0-9]+(?:[.,:/][0-9]+)*\s?(?:{decontaminate.UNITS})\b", f" {decontaminate.NUMBER} {decontaminate.UNIT} ", text)
    text = re.sub("[0-9]+(?:[.,:/][0-9]+)*", decontaminate.NUMBER, text)
    found = []
    for names in (r"(?<=[^.!?\s]\s)[A-Z][a-z]+(?![A-Za-z])", r"(?<![A-Za-z])[A-Z][a-z]+(?![A-Za-z])"):
        words = re.sub(r"[!-/:-@\[-`{-~]", "", re.sub(names, decontaminate.NAME, text).lower()).split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        found.append({w for w in windows if sum(any(k in x for k in (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT)) for x in w) <= 2})
    return found


def test_op7_finds_reparameterised_items(spark):
    """Items with other numbers, names and units, spread over documents: all come back, and nothing that plain code would
    not call a candidate."""
    rng = random.Random(12)
    words = ["the", "old", "baker", "sells", "fresh", "bread", "from", "north", "river", "when", "many", "small", "boats", "carry", "fish", "and", "salt", "over", "to", "market", "every", "winter", "how", "much", "does", "one", "basket", "cost"]
    names = ["Anna", "Bert", "Carla", "Dirk", "Elsa", "Frank", "Greta"]
    items, docs, want = [], [], set()
    for k in range(40):
        parts = [rng.choice(words) for _ in range(rng.randrange(16, 30))]
        slots = sorted(rng.sample(range(2, len(parts)), 3))
        shape = lambda number, name, unit: " ".join(f"{number} {unit}" if i == slots[0] else name if i == slots[1] else str(number + 5) if i == slots[2] else w for i, w in enumerate(parts))  # noqa: B023, E731
        items.append((k, shape(10 + k, rng.choice(names), "km")))
        filler = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))
        changed = shape(200 + 3 * k, rng.choice(names), rng.choice(["kg", "miles"]))
        texts = [f"{filler()} {items[-1][1]} {filler()}", f"{filler()} {changed} {filler()}", f"{items[-1][1]} {filler()} {changed}", f"{filler()} {changed.replace(' ', '  ')} {filler()}", f"{filler()}\n {changed}\n{filler()}"]
        for text in texts:
            want.add((len(docs), k))
            docs.append((len(docs), text))
    docs += [(len(docs) + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(100)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want)
    of_items = {k: plain_windows(t) for k, t in items}
    for i, k in got:
        held = set().union(*plain_windows(docs[i][1]))
        assert any(w and len(w & held) >= 0.8 * len(w) for w in of_items[k])


def test_op7_a_window_that_all_share_makes_no_pairs(spark):
    """All items and documents share one long beginning; only rarer windows bring them together."""
    shared = "please read the following question with care and then write down the right answer"
    own = lambda k: "abcdefghijklmnopqrst"[k // 20] + "abcdefghijklmnopqrst"[k % 20]  # noqa: E731  letters, as numbers would be slots
    items = [(k, f"{shared} what is the item{own(k)} of thing{own(k)} in place{own(k)}") for k in range(30)]
    docs = [(i, f"{shared} nothing{own(i)} more{own(i)} is said here{own(i)} now{own(i)}") for i in range(200)] + [(500 + k, t) for k, t in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(500 + k, k) for k in range(30)}


def test_op1_columns_of_any_name(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x", "a", "b", 1), (2, "u", "x", "c", "d", 2)], "page_id long, url string, html string, payload_digest string, refers_to string, first_id int")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "w")).collect()) == [(1, "response", None), (2, "revisit", 1)]


def _pipeline(spark, folder, docs, items, extra=()):
    import corpus_pipeline as C

    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return C.run(spark, str(folder))


def test_pipeline_over_hard_tables(spark, tmp_path):
    text = lambda k: " ".join(f"Word{k} of the {i} plain story goes on and on{k}." for i in range(12))
    item = "how many long wooden boats does the old captain need to cross the wide river at night"
    docs = [(1, text(1)), (1, text(1)), (2, None), (None, text(2)), (None, text(2)), (3, ""), (4, text(3) + " " + item), (5, text(4)), (None, None)]
    clash = ("node", "digest", "row", "run", "text_hash", "bands", "key_id", "bad_id", "kept_id", "seeds", "score")
    rows = _pipeline(spark, tmp_path, docs, [(1, item), (None, None)], clash).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 1), (False, 5), (True, None)]


def test_pipeline_over_empty_tables(spark, tmp_path):
    assert _pipeline(spark, tmp_path, [], []).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and Counter(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_intermediate_tables_go_when_they_are_cleared(spark):
    from sitewright.llm import common

    kept, gone = common.written(spark.range(3).toDF("x"), "kept"), common.written(spark.range(4).toDF("x"), "gone")
    common.removed(spark, gone)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.collect()
    common.clear(spark)
    with pytest.raises(Exception):
        kept.collect()


def test_hot_keys_are_counted_as_others(spark):
    from sitewright.llm import common

    rows = spark.range(3010).select(F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3003, "some").otherwise(F.col("id").cast("string")).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(r.id for r in common.counted_twice(rows, counts, "k").collect()) == list(range(3003))
    assert common.counted_twice(rows.limit(0), counts.limit(0), "k").count() == 0
