"""The corpus operators against brute force on small hard tables."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import bpe, decontaminate, exact_dedup, neardup, pii, quality, sharding, substring, toxicity, warc

LONG = " ".join(f"w{i}" for i in range(40))
HARD = [
    (1, "a b\tc"), (2, "abc"), (3, " abc "), (3, " abc "), (None, "abc  "), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, LONG + " tail"), (9, "pre " + LONG), (10, "x " * 5000), (11, "é日本😀" * 3), (None, None), (12, LONG),
]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operators name theirs."""
    rows = [(i, t, "en", "s", i, "n", 1, "k") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string, id long, node string, row_key int, shard string")


@pytest.fixture(scope="module")
def empty(hard):
    return hard.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(hard, empty):
    rows = exact_dedup.exact_groups(hard).collect()
    groups = defaultdict(list)
    for i, t in HARD:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    assert len(rows) == len(HARD)
    sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    assert all(r.group_size == len(sha[r.text_sha256]) and r.keep_id == sha[r.text_sha256][0][3] for r in rows)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(sha.keys())
    kept = exact_dedup.drop_exact_duplicates(hard)
    assert kept.columns == hard.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_shards(hard, empty):
    rows = sharding.shard_documents(hard, shards=4).collect()
    assert len(rows) == len(HARD)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(4))
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in HARD)
    assert sharding.shard_documents(empty).count() == 0


def test_best_fit_matches_a_plain_search():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randrange(1, 60) for _ in range(200)]
        got, n = sharding.best_fit_decreasing(sizes, 100)
        rooms, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = min(((r, b) for b, r in enumerate(rooms) if r >= sizes[i]), default=None)
            if fit is None:
                rooms.append(100)
                fit = (100, len(rooms) - 1)
            rooms[fit[1]] -= sizes[i]
            want[i] = fit[1]
        assert got == want and n == len(rooms)
    loads = Counter()
    sizes = [5000] + [rng.randrange(1, 50) for _ in range(2000)]
    for s, b in zip(sizes, sharding.pack_into(sizes, 8), strict=True):
        loads[b] += s
    rest = [v for v in loads.values() if v < 20000]
    assert len(loads) == 8 and max(rest) - min(rest) < 60


def test_warc(spark, tmp_path):
    data = [(2, "http://a/", "x"), (1, "http://b/", "x"), (3, None, None), (4, "u", ""), (None, "u", "x"), (5, "u", "é" * 3000), (5, "u", "é" * 3000)]
    pages = spark.createDataFrame([(*r, 0) for r in data], "page_id long, url string, html string, payload int")
    rows = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows) == Counter({(1, "response", None, 1): 1, (2, "revisit", 1, 1): 1, (None, "revisit", 1, 1): 1, (3, "response", None, 0): 1, (4, "revisit", 3, 0): 1, (5, "response", None, 6000): 2})
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0
    for file in (tmp_path / "w").glob("part-*"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1")


def test_warc_reader_checks():
    good = warc.page_member(1, "u", b"hello", warc.base32_sha1(b"hello"), None)
    assert [r.payload for r in warc.read_records(iter([good[:7], good[7:] + good]))] == [b"hello", b"hello"]
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(iter([good[:-20]])))
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(iter([warc.page_member(1, "u", b"hello", warc.base32_sha1(b"other"), None)])))
    large = warc.write_member([("WARC-Type", "resource")], bytes(17 << 20))
    assert large[-1] and [len(r.block) for r in warc.read_records(iter([large + b"\0" + good]))] == [17 << 20, len(next(warc.read_records(iter([good]))).block)]


def test_pii(hard, empty):
    assert pii.find_personal_data(hard).count() == len(HARD) and pii.find_personal_data(empty).count() == 0
    finder, rng = pii.Finder(), random.Random(1)
    parts = ["@", ".", "a", "b.c", "-", "+", "1", "255", "256", "4111111111111111", " ", "(", ")", "x@y.zz", "1.2.3.4", "é", "٣", "tel:", "00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        found = finder.spans(text)
        assert found["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert found["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert found["card"] == [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        assert found["phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    assert pii.redact("IBAN DE89 3704 0044 0532 0130 00 x") == "IBAN [iban] x"


def test_pii_accounts_end_where_their_digits_hold():
    account, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for tail in (" BIC COBADEFF", " 12 2024", " 2024-01-02", " AND MORE", " x", "", ".", " 5 EUR", " ABCD EFGH IJKL MNOP QRST UVWX YZ"):
        assert pii.redact(f"IBAN {account}{tail}") == f"IBAN [iban]{tail}"
        assert pii.redact(f"iBAN: {other.lower()}{tail}") == f"iBAN: [iban]{tail}"
    assert pii.redact("IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFF") == "IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFF"
    assert pii.redact("IBAN DE89370400440532013000X") == "IBAN DE89370400440532013000X"
    for cue in ("tel:", "Tel:", "TEL:", "Tel: "):
        assert pii.redact(f"{cue}030-1234567 x") == f"{cue}[tel] x"
    assert pii.redact("Ssn 123-45-6789") == "Ssn [ssn]"


def test_quality(hard, empty):
    rows = quality.score_documents(hard, quality.fit(hard)).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(hard).columns == hard.columns
    assert quality.score_documents(empty, quality.fit(empty)).count() == 0


def test_quality_separates(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["la", "no", "ter", "mi", "so"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "", "", ",", "."]) for _ in range(400)]
    clean = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))  # noqa: E731  words seldom repeat, as in prose
    junk = [" ".join(w + "%%%" for w in clean().split()), "BUY!! NOW!! " * 30, "same same same " * 30, " | ".join(clean().split())]
    docs = spark.createDataFrame([(i, clean()) for i in range(200)] + [(1000 + i, junk[i % 4]) for i in range(40)], "doc_id long, text string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == set(range(200))


def test_bpe(hard, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    codec, rng = bpe.Codec(bpe.load_file(path)), random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "日本", "😀", "1", "٣", "'s", "'ll", "!", "<|endoftext|>", "<|end", "ation", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "a" * 9000, " " * 99]
    for text, ids, want in zip(texts, codec.encode_batch(texts), reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert codec.decode(ids) == reference.decode(want.ids, skip_special_tokens=False)
    back = {(r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(hard, path), path).collect()}
    assert back == {(i, t or "") for i, t in HARD}
    assert bpe.round_trip_digests(empty, path).count() == 0


def test_decontaminate(spark, hard, empty):
    item = "If 12 workers dig a trench of 30 meters in a week how many workers does Anna need for 90 meters"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (1, item)], "item_id long, text string")
    changed = item.replace("12", "7").replace("Anna", "Bert").replace("30", "55")
    docs = spark.createDataFrame([(1, "before it " + item + " after"), (2, "so " + changed + " so"), (3, item.replace("trench", "ditch").replace("week", "day").replace("need", "want")), (4, None), (5, ""), (1, "before it " + item + " after")], "doc_id long, text string")
    got = decontaminate.find_contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.find_contaminated(hard, bench).count() == 0 and decontaminate.drop_contaminated(hard, bench).columns == hard.columns
    assert decontaminate.find_contaminated(empty, bench).count() == 0 and decontaminate.find_contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_judges_each_occurrence(spark):
    item = "If 12 workers dig a trench of 30 meters in a week how many workers does Anna need for 90 meters"
    changed = item.replace("12", "7").replace("30", "55").replace("Anna", "Bert")
    docs = [(1, f"so {item} and then {changed}"), (2, f"so {changed} " + "and so on " * 3000 + f"how many workers does Carl need for 4 meters {item}"), (3, item.replace("of 30", "of about 30")), (4, item.replace("trench", "ditch").replace("week", "day").replace("need", "want") + " " + changed[:60])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_contaminated(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} >= {1, 2} and 4 not in {r.doc_id for r in got}
    twice = "Sam has 3 red apples and Sam has 3 green apples while Eve has 8 red apples and 9 green ones"
    inconsistent = "Sam has 5 red apples and Ann has 6 green apples while Bob has 7 red apples and 4 green ones"
    frame = spark.createDataFrame([(1, "so " + twice + ". Again: " + inconsistent), (2, "so " + inconsistent)], "doc_id long, text string")
    got = decontaminate.find_contaminated(frame, spark.createDataFrame([(1, "so " + twice)], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [1]


def test_decontaminate_short_dense_and_named_items(spark):
    ann = "Ann bakes 12 small loaves of dark bread for the village market today. Ann sells 4 of the loaves to an old baker. Ann eats 2 of them at home with some butter. How many loaves are left on the table at the end"
    items = [(1, "Compute 3 + 4 * 12 - 7 / 2 and 8 * 9."), (2, "Who wrote Don Quixote?"), (3, ann), (4, "..."), (5, "Add 1.5 to 2")]
    docs = [(1, "Now: compute 3 + 4 * 12 - 7 / 2 and 8 * 9. Good."), (2, '"Who wrote Don Quixote?" they asked'), (3, "Task. " + ann.replace("Ann", "Leo").replace("12", "15")), (4, "Compute 5 + 6 * 11 - 2 / 3 and 1 * 7."), (5, "who wrote the book of Don Quixote"), (6, "add 15 to 2 ... or")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(frame, bench).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (3, 3)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(frame, bench).collect()) == [4, 5, 6]


@pytest.mark.parametrize(("window", "group"), [(35, 20_000), (9, 20_000), (35, 3), (20, 2), (8, 1)])
def test_substring(spark, hard, empty, window, group):
    rng = random.Random(7)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(4)]
    texts = [(i, " ".join(x for _ in range(3) for x in ([f"u{rng.random()}"] * rng.randrange(1, 5) + rng.choice(passages)[rng.randrange(20) : rng.randrange(30, 60)]))) for i in range(40)] + HARD
    count = Counter(tuple(w[k : k + window]) for _, t in texts for w in [words(t)] for k in range(len(w) - window + 1))
    want = Counter()
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, seed int")
    assert Counter(map(tuple, substring.remove_repeats(docs, window, group=group).collect())) == want
    assert substring.remove_repeats(empty).count() == 0


def test_near(spark, hard, empty):
    rng = random.Random(11)
    base = [[f"b{k}_{i}" for i in range(120)] for k in range(5)]
    texts = []
    for i in range(60):
        w = list(base[i % 5])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        texts.append((i, " ".join(w)))
    texts += [(100, "one two"), (101, "one two"), (102, "one  two"), (103, None), (104, ""), (105, " ")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, bucket int")
    freq, n = neardup.document_frequencies(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    weights = neardup.place_weights(freq, n)
    links = {i: i for i, _ in texts}

    def find(x):
        while links[x] != x:
            x = links[x]
        return x

    data = [(i, (t or "").encode()) for i, t in texts]
    for x, (i, a) in enumerate(data):
        sims = neardup.similarities([a] * (len(data) - x), [b for _, b in data[x:]], neardup.Shingler(), weights)
        for (j, b), s in zip(data[x:], sims, strict=True):
            if s >= 0.8 - 1e-9 or a == b:
                links[max(find(i), find(j))] = min(find(i), find(j))
    rows = neardup.near_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: find(i) for i in links}
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {find(i) for i in links}
    assert neardup.near_classes(empty).count() == 0
    assert neardup.near_classes(hard).count() == len(HARD)


def test_toxicity(spark, hard, empty):
    rng = random.Random(13)
    plain = lambda: " ".join(rng.choice(["water", "house", "river", "stone", "quiet", "garden"]) for _ in range(30))
    bad = ["idiot", "moron", "scumbag"]
    docs = [(i, plain() + (" " + rng.choice(bad) if i % 4 == 0 else "")) for i in range(400)] + [(1000, plain() + " 1d10t"), (1001, plain() + " m o r o n"), (1002, plain() + " idiooooot"), (1003, plain()), (1004, None), (None, "")]
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(frame, labels).collect()}
    assert all(rows[i].predicted == (i % 4 == 0) for i in range(400))
    assert all(rows[i].predicted for i in (1000, 1001, 1002)) and not any(rows[i].predicted for i in (1003, 1004, None))
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(hard, labels.limit(0)).count() == len(HARD)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    text = lambda k: " ".join(f"Word{k} of the {i} plain story goes on and on{k}." for i in range(12))
    item = "how many long wooden boats does the old captain need to cross the wide river at night"
    docs = [(1, text(1)), (2, text(1) + " "), (3, text(1).replace("story", "tale", 1)), (4, "BUY!! " * 60), (5, text(5) + " " + item), (6, text(6))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) in ([2, 6], [3, 6])


@pytest.mark.parametrize("limits", [(3, 1 << 20), (1024, 500), (1024, 1 << 21)])
def test_near_blocks(spark, limits):
    """Blocks of any size join the same nodes of each bucket as comparing all pairs does."""
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choice("xyz") + str(rng.random()) if rng.random() < 0.04 else w for w in base) for _ in range(40)]
    texts += ["one", "one two three four five six"] + [" ".join(base)] * 2
    weights = neardup.place_weights(np.ones(1 << neardup.TABLE_BITS), 100)
    nodes = [i.to_bytes(2, "big") for i in range(len(texts))]
    bucket = [[i for i in range(len(texts)) if i % 3 != 1], [i for i in range(len(texts)) if i % 3 != 2]]
    main = 4  # of each bucket the nodes below it are one class already, and do not wait
    root = [nodes[0] if i < main else nodes[i] for i in range(len(texts))]
    rows = [(k, nodes[i], root[i], i >= main, len(texts[i])) for k, b in enumerate(bucket) for i in b]
    placed = spark.createDataFrame(rows, "bucket long, node binary, root binary, waiting boolean, n_bytes int")
    table = spark.createDataFrame(list(zip(nodes, texts, strict=True)), "node binary, text string")
    found = neardup.block_links(placed, table, weights, 0.8, *limits).collect()

    def classes(links):
        up = {n: r for n, r in zip(nodes, root, strict=True)}
        for a, b in links:
            x, y = up[a], up[b]
            up = {n: min(x, y) if r in (x, y) else r for n, r in up.items()}
        return up

    every = {(i, j) for b in bucket for i in b for j in b if i < j}
    pairs = sorted(every)
    sims = neardup.similarities([texts[i].encode() for i, _ in pairs], [texts[j].encode() for _, j in pairs], neardup.Shingler(), weights)
    true = {(nodes[i], nodes[j]) for (i, j), s in zip(pairs, sims, strict=True) if s >= 0.8 - 1e-9}
    links = {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in found}
    assert links and links <= true and classes(links) == classes(true)


def test_toxicity_viterbi_is_exhaustive_search():
    import itertools

    rng = np.random.default_rng(3)
    cost = toxicity.language_model(rng.integers(0, 50, toxicity.SYMBOLS**3))
    restorer, pick = toxicity.Restorer(cost), random.Random(4)

    def total(letters, noise):
        a = b = 0
        for c in letters + " ":
            z = toxicity.CODE[c]
            noise, a, b = noise + cost[a][b][z], b, z
        return noise

    for _ in range(200):
        noisy, spread = "".join(pick.choice("abdt10@$!*#") for _ in range(pick.randrange(1, 6))), pick.random() < 0.5
        runs = [(m[1], len(m[0])) for m in toxicity.RUNS.finditer(noisy)]
        every = [restorer.options(c, n, spread and k > 0) for k, (c, n) in enumerate(runs)]
        paths = [("".join(o[0] for o in path), sum(o[2] for o in path)) for path in itertools.product(*every)]
        best = min(total(*p) for p in paths)
        got = restorer.word(noisy, spread)
        assert min(total(*p) for p in paths if p[0] == got) == pytest.approx(best), noisy


def test_toxicity_is_linear_in_long_words():
    import base64
    import time

    reader = toxicity.Reader(toxicity.language_model(np.ones(toxicity.SYMBOLS**3, np.int64)))
    blob = base64.b64encode(random.Random(5).randbytes(600_000)).decode()
    began = time.perf_counter()
    for text in ("x" * 200_000, "ab1" * 70_000, "日本" * 500_000, "1" * 100_000 + "a", "a" + "12" * 100_000, blob):
        reader.marks(text)
    assert time.perf_counter() - began < 40


def test_toxicity_reads_disguises():
    text = " ".join(["you idiot"] * 50 + ["bitch"] * 20 + ["shit ass"] * 20 + ["the water of the river"] * 20)
    reader = toxicity.Reader(toxicity.language_model(toxicity.letter_counts([text])))
    for disguised, word in (("1d10t", "idiot"), ("bitc#", "bitch"), ("shi7", "shit"), ("a$$", "ass"), ("i d i o t", "idiot"), ("i d.i o-t", "idiot"), ("i/d/i/o/t", "idiot"), ("y o u i d i o t", "idiot"), ("a$$!", "ass"), ("idiooooot", "idiot")):
        assert word in reader.marks(f"the {disguised} of"), disguised
    assert {"the", "water", "2024"} & reader.marks("the water 2024") == {"the", "water"}


def test_near_keeps_one_row_of_each_class(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join(base[:99] + ["x"])
    rows = [(7, " ".join(base)), (7, near), (7, near), (9, "alone"), (None, "null one two three four five"), (None, "null one two three four five"), (None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_classes(docs).collect()
    by_class = defaultdict(list)
    for r in found:
        by_class[r.class_id, r.class_size].append(r.kept)
    assert {k: (len(v), sum(v)) for k, v in by_class.items()} == {(7, 3): (3, 1), (9, 1): (1, 1), (None, 2): (2, 1), (3, 4): (4, 1)}
    assert neardup.drop_near_duplicates(docs).count() == 4


def test_substring_tells_words_of_one_polynomial_hash_apart(spark):
    flip = lambda w: w.translate(str.maketrans("ab", "ba"))
    word = "a"
    while len(word) < 4096:
        word += flip(word)
    common = [f"c{i}" for i in range(34)]
    docs = [(1, " ".join([*common, word])), (2, " ".join([*common, flip(word)])), (3, " ".join(["x", *common, "y"])), (4, " ".join(["z", *common, "y"]))]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 35, 4: 35}


def test_exact_merges_any_number_of_runs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("abcdefgh") * rng.randrange(1, 3) + " " * rng.randrange(3)) for i in range(500)]
    want = defaultdict(list)
    for i, t in rows:
        want[t.replace(" ", "")].append((-len(t), i))
    for parts in (1, 2, 3, 8, 13):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = exact_dedup.exact_groups(docs).collect()
        assert {r.id: (r.keep_id, r.group_size, r.kept) for r in got} == {i: (min(g)[1], len(g), min(g)[1] == i) for g in want.values() for _, i in g}


def test_pii_added_kinds_are_all_found(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def routing():
        while not pii.routing_ok(d := digits(9)):
            pass
        return d

    def iban():
        country = rng.choice(sorted(pii.LENGTHS))
        body = digits(pii.LENGTHS[country] - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        code = f"{country}{check:02d}{body}"
        return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if rng.random() < 0.5 else code

    made = {
        "tel": lambda: rng.choice("23456789") + digits(9), "iban": iban, "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "login": lambda: f"user{digits(2)}:pw{digits(3)}", "account": lambda: digits(rng.randrange(6, 13)), "routing": routing,
    }
    finder = pii.Finder()
    for kind, make in made.items():
        for cue in pii.CUES[kind]:
            for shown in (cue, cue.upper(), cue.title()):
                value = make()
                before, after = f"words 12 and {shown}" + rng.choice(["", " "] if kind != "login" else [""]), "@host/x" if kind == "login" else rng.choice([", then", " then words", "."])
                found = finder.spans(before + value + after)[kind]
                assert [(before + value + after)[a:b] for a, b in found] == [value], (kind, before + value + after)


def test_pii_offsets_hold_where_small_letters_are_longer():
    text = "İİ TEL: 5551234567 and İ IBAN DE89370400440532013000 x"
    found = pii.Finder().spans(text)
    assert [text[a:b] for kind in ("tel", "iban") for a, b in found[kind]] == ["5551234567", "DE89370400440532013000"]
