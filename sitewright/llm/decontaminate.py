"""Benchmark decontamination by templates, in DataFrame functions only.

Text is brought to a template: numbers, names and units become typed placeholders, letters are lowered, punctuation
goes. Windows of five template words are hashed and joined with those of the benchmark, so a question whose numbers
or names were changed still meets its template. A window counts if at least three of its words are not placeholders.

A capitalised word that begins a sentence may be a name or not, so it is read both ways: documents give the windows of
both readings, and an item has two forms, its first words as words or as names. The second form is used if at least
half as many of its windows count. Items of which no window counts (short ones, or dense in numbers and names) are met
literally: by windows of five words as they stand, or by all their words if they have fewer.

A document is a candidate for an item if it holds at least `similarity` of the windows of one form. For candidates the
slots are then read: where the matched windows put placeholders, each value of the item must have become one value.
That is judged over the whole document, and for each occurrence in it: the matched windows with one shift between
document and item, or with shifts that differ by less than half the item's length. A pair is reported if at least
`similarity` of the item's slot values are consistent in the whole document, or in one occurrence that by itself
holds at least `similarity` of the item's windows. The figures are those of the first of these that holds.

Documents keep the distinct windows that occur in the benchmark at all: those of the benchmark are broadcast if they are
counted to be at most MOST_BROADCAST, else joined by a shuffle, with the same result. An item then meets documents by
its rarest windows alone: who holds `similarity` of n windows holds one of any n - ceil(similarity * n) + 1 of them. A
window that many items and documents share therefore makes no pairs, unless an item has no rarer ones. What met is
written down, and all windows of these pairs are counted.

Defined results: null texts are empty; items without words match nothing; items and documents may repeat (each row of
either counts by its id and text); empty tables give no rows; other columns are left alone. Names are words with one
capital, the first; words all in capitals are words. Pairs met literally have no slots.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Units of measure, as words after a number.
UNITS = "km|kg|mg|cm|mm|ml|kmh|mph|lbs|ft|hz|khz|mhz|ghz|kb|mb|gb|tb|percent|meters|metres|miles|hours|minutes|seconds|days|weeks|months|years|dollars|euros|pounds|grams|liters|litres|degrees"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~„“”‘’«»…¿¡–—"
PUNCTUATION_CLASS = "[!-/:-@\\[-`{-~„“”‘’«»…¿¡–—]"
#: Capitalised words inside a sentence, and anywhere; the capital is looked for first, as few characters are one.
NAMES = "\\p{Lu}(?<=[^.!?\\s]\\s\\p{Lu})\\p{Ll}+(?!\\p{L})"
ALL_NAMES = "(\\p{Lu})(?<!\\p{L}\\p{Lu})(\\p{Ll}+)(?!\\p{L})"
EITHER = "\ue003"  # before a word that may be a name
WORDS = 5
LEAST_WORDS = 3
MOST_BROADCAST = 250_000  # windows: a key of 8 bytes, about 64 with its place in the hashed relation, so 16 MB


def _single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "\\s{2,}|[^\\S ]", " ")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def readings(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, t and u: the template words, with capitalised words that begin a sentence as words (t) and as names (u)."""
    text = F.regexp_replace(_single_blanks(text), f"(?i)[0-9]+(?:[.,:/][0-9]+)*\\s?(?:{UNITS})\\b", f" {NUMBER} {UNIT} ")
    text = F.regexp_replace(text, "[0-9]+(?:[.,:/][0-9]+)*", NUMBER)
    text = F.regexp_replace(F.regexp_replace(text, NAMES, NAME), ALL_NAMES, f"{EITHER}$1$2")
    base = df.select(*keys, F.regexp_replace(F.lower(text), PUNCTUATION_CLASS, "").alias("base"))
    as_words, as_names = F.replace(F.col("base"), F.lit(EITHER), F.lit("")), F.regexp_replace("base", f"{EITHER}\\p{{L}}+", NAME)
    return base.select(*keys, _split(as_words).alias("t"), _split(as_names).alias("u"))


def valued(text: Column) -> Column:
    """The text cut into the same words as its template, with the values still there."""
    text = F.regexp_replace(_single_blanks(text), f"(?i)([0-9]+(?:[.,:/][0-9]+)*)\\s?({UNITS})\\b", " $1 $2 ")
    text = F.regexp_replace(text, "([0-9])[.,:/](?=[0-9])", "$1")
    return F.translate(F.lower(text), PUNCTUATION, "")


def is_slot(word: Column) -> Column:
    return word.rlike(f"[{NUMBER}{NAME}{UNIT}]")


def _starts(words: Column) -> Column:
    return F.when(F.size(words) >= WORDS, F.sequence(F.lit(0), F.size(words) - WORDS)).otherwise(F.array().cast("array<int>"))


def _other_starts(t: Column, u: Column) -> Column:
    """Where a window of u is not that of t."""
    differ = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i) != F.get(u, i))
    around = F.flatten(F.transform(differ, lambda p: F.sequence(F.greatest(F.lit(0), p - WORDS + 1), F.least(p, F.size(t) - WORDS))))
    return F.when((F.size(t) >= WORDS) & (t != u), F.array_distinct(around)).otherwise(F.array().cast("array<int>"))


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])


def _counted(words: Column, at: Column) -> Column:
    """The hashes of an item's windows that count."""
    slots = lambda i: sum((is_slot(F.get(words, i + k)).cast("int") for k in range(1, WORDS)), is_slot(F.get(words, i)).cast("int"))
    return F.transform(F.filter(at, lambda i: slots(i) <= WORDS - LEAST_WORDS), lambda i: _window_hash(words, i))


def _in_step(words: str, n: int = WORDS) -> list[Column]:
    """The words and, in step with them, the next n - 1."""
    c = F.col(words)
    return [c, *[F.slice(c, F.lit(k + 1), F.greatest(F.size(c), F.lit(1))) for k in range(1, n)]]


def _fields(words: str, first: int) -> list[Column]:
    """What _in_step() gave, of a struct z zipped from its place `first` on."""
    return [F.col("z").getField(words if k == 0 else str(first + k)) for k in range(WORDS)]


def each_window(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys and w, a row for each window of either reading; windows that do not count are not told apart, as no item
    has them. Windows are taken from zipped arrays, so that their hashes are computed in generated code.

    What is exploded must not be a bare column: for that Spark infers a filter and pushes it down with its whole
    expression, which would cut all words again for each window.
    """
    rows = readings(df, keys, text).select(*keys, F.explode(F.arrays_zip(*_in_step("t"), *_in_step("u"))).alias("z"))
    t, u = _fields("t", 0), _fields("u", WORDS)
    differ = reduce(or_, (a != b for a, b in zip(t, u, strict=True)))
    return rows.filter(t[-1].isNotNull()).select(*keys, F.explode(F.array(F.xxhash64(*t), F.when(differ, F.xxhash64(*u)))).alias("w"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, form (0: first words as words, 1: as names), w (hash) and n (the form's distinct windows)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text")).dropDuplicates()
    words = readings(items, ["item_id"], F.col("text"))
    forms = [words.select("item_id", F.lit(k).alias("form"), F.explode(_counted(F.col(c), _starts(F.col(c)))).alias("w")) for k, c in enumerate("tu")]
    each = forms[0].unionByName(forms[1]).distinct()
    own = Window.partitionBy("item_id")
    counted = each.withColumn("n", F.count("*").over(Window.partitionBy("item_id", "form"))).withColumn("first", F.max(F.when(F.col("form") == 0, F.col("n"))).over(own))
    return counted.filter(F.col("n") * 2 >= F.col("first")).drop("first")


def literal_words(text: Column) -> Column:
    """The words in small letters, without punctuation at their ends; signs of arithmetic that stand alone are words."""
    ends = "[\\p{Punct}„“”‘’«»…¿¡–—]+"
    text = F.regexp_replace(F.lower(_single_blanks(text)), "(?<![^ ])[-+*/=<>^%](?![^ ])", f"{EITHER}$0{EITHER}")
    return _split(F.regexp_replace(text, f"(?<![^ ]){ends}|{ends}(?![^ ])", ""))


def _literal_windows(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """keys, k and w: the windows of k words, for each of lengths, of df (keys and words)."""
    rows = df.select(*keys, F.explode(F.arrays_zip(*_in_step("words"))).alias("z"))
    z = _fields("words", 0)
    hashes = [F.when(z[k - 1].isNotNull(), F.struct(F.lit(k).alias("k"), F.xxhash64(*z[:k]).alias("w"))) for k in lengths]
    return rows.select(*keys, F.explode(F.array(*hashes)).alias("x")).filter("x IS NOT NULL").select(*keys, "x.k", "x.w")


def literal_pairs(docs: DataFrame, benchmark: DataFrame, items: DataFrame, similarity: float, item_col: str, item_text_col: str) -> DataFrame | None:
    """doc_id, text_hash, item_id, n, hits for items that have words, but no window in items; none if there is no such item."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text")).dropDuplicates()
    words = readings(rows, ["item_id", "text"], F.col("text"))
    short = words.filter((F.size(_counted(F.col("t"), _starts(F.col("t")))) == 0) & (F.size(_counted(F.col("u"), _starts(F.col("u")))) == 0))
    bare = short.select("item_id", literal_words(F.col("text")).alias("words")).select("item_id", "words", F.xxhash64("words").alias("form"), F.least(F.size("words"), F.lit(WORDS)).alias("own"))
    each = _literal_windows(bare, ["item_id", "form", "own"], list(range(1, WORDS + 1))).filter("k = own").select("item_id", "form", "k", "w").distinct()
    asked = written(each.withColumn("n", F.count("*").over(Window.partitionBy("item_id", "form"))), "literal-windows")
    lengths = sorted(r.k for r in asked.select("k").distinct().collect())  # at most WORDS
    if not lengths:
        return None
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), literal_words(F.col("text")).alias("words"))
    return held_pairs(_literal_windows(words, ["doc_id", "text_hash"], lengths).drop("k"), asked.drop("k"), similarity).drop("form")


def held_pairs(windows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_hash, item_id, form, n, hits where a document holds at least `similarity` of the n windows of an
    item's form. windows: doc_id, text_hash, w; items: item_id, form, w, n, each window once."""
    asked = items.select("w").distinct()
    few = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    seen = written(windows.join(F.broadcast(asked) if few else asked, "w", "left_semi").groupBy("doc_id", "text_hash", "w").agg(F.lit(1).alias("one")).drop("one"), "seen")
    often = items.join(seen.groupBy("w").agg(F.count("*").alias("df")), "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = F.row_number().over(Window.partitionBy("item_id", "form").orderBy("df", "w"))
    rare = often.withColumn("place", rarest).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1).filter("df > 0").select("item_id", "form", "n", "w")
    met = written(seen.join(written(rare, "rare"), "w").select("doc_id", "text_hash", "item_id", "form", "n").distinct(), "met")
    all_of = met.join(items.select(F.col("item_id").alias("i"), F.col("form").alias("f"), "w"), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("form") == F.col("f"))).drop("i", "f")
    held = seen.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("w").alias("v"))
    both = all_of.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("w") == F.col("v")))
    hits = both.groupBy("doc_id", "text_hash", "item_id", "form", "n").agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") >= F.col("n") * similarity)


def _placed_rows(df: DataFrame, keys: list[str], every: bool) -> DataFrame:
    """keys, form, length (words of the text), pos, w, and the slot values of each window: struct(kind, place in the window, value).
    df: keys and text. every: all windows of the second reading, else those that the first does not have."""
    base = readings(df.select(*keys, "text", _split(_single_blanks(valued(F.col("text")))).alias("v")), [*keys, "v"], F.col("text"))
    base = base.filter(F.size("t") == F.size("v"))
    t, u, v = F.col("t"), F.col("u"), F.col("v")
    one = lambda form, c: lambda i: F.struct(
        F.lit(form).alias("form"), i.alias("pos"), _window_hash(c, i).alias("w"),
        F.filter(F.array(*[F.struct(F.get(c, i + k).alias("kind"), F.lit(k).alias("place"), F.get(v, i + k).alias("value")) for k in range(WORDS)]), lambda x: is_slot(x["kind"])).alias("slots"),
    )
    windows = F.concat(F.transform(_starts(t), one(0, t)), F.transform(_starts(u) if every else _other_starts(t, u), one(1, u)))
    rows = base.select(*keys, F.size("t").alias("length"), F.explode(windows).alias("x")).select(*keys, "length", "x.form", "x.pos", "x.w", "x.slots")
    return rows.filter(F.size("slots") <= WORDS - LEAST_WORDS)


def _occurrences(shift: Column, length: Column) -> Column:
    """Where a matched window counts: the document, its exact shift, and two staggered ranges of half an item's length."""
    half = F.greatest(F.lit(2), F.floor(length / 2))
    places = [F.lit(0), shift, F.floor(shift / half), F.floor((shift + half / 2) / half)]
    return F.array(*[F.struct(F.lit(k).alias("level"), x.cast("long").alias("place")) for k, x in enumerate(places)])


def find_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, n_hit, coverage, n_slots, n_consistent for each contaminated pair."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = written(item_windows(benchmark, item_col, item_text_col), "item-windows")
    windows = each_window(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), ["doc_id", "text_hash"], F.col("text"))
    pairs = written(held_pairs(windows, items, similarity), "contaminated")
    keys = pairs.select("doc_id", "text_hash").distinct()
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    suspects = hashed.join(keys, hashed.doc_id.eqNullSafe(keys.doc_id) & (hashed.text_hash == keys.text_hash), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    asked = items.select("w").distinct()
    doc_rows = _placed_rows(suspects, ["doc_id", "text_hash"], every=False).join(asked, "w", "left_semi")
    item_rows = _placed_rows(benchmark.select(F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text")), ["item_id"], every=True).dropDuplicates()
    a, b, p = doc_rows.alias("a"), item_rows.alias("b"), pairs.alias("p")
    met = p.join(b, F.col("p.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("p.form") == F.col("b.form"))).join(a, F.col("a.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("a.text_hash") == F.col("p.text_hash")) & (F.col("a.w") == F.col("b.w")))
    became = F.transform(F.arrays_zip(F.col("b.slots").alias("x"), F.col("a.slots").alias("y")), lambda z: F.struct(z["x"]["kind"].alias("kind"), z["x"]["value"].alias("value"), z["y"]["value"].alias("now")))
    pair = ["doc_id", "text_hash", "item_id"]
    placed = met.select("p.doc_id", "p.text_hash", "p.item_id", "p.form", "p.n", F.col("p.hits").alias("all_hits"), "a.w", became.alias("became"), F.explode(_occurrences(F.col("a.pos") - F.col("b.pos"), F.col("b.length"))).alias("o"))
    each = placed.select(*pair, "form", "n", "all_hits", "w", "o.level", "o.place", F.explode_outer("became").alias("z"))
    seen = each.groupBy(*pair, "form", "n", "all_hits", "level", "place").agg(F.count_distinct("w").alias("hits"), F.collect_set("z").alias("ways"))
    values = seen.withColumn("slots", F.array_distinct(F.transform("ways", lambda z: F.struct(z["kind"].alias("kind"), z["value"].alias("value")))))
    steady = F.filter("slots", lambda x: F.size(F.filter("ways", lambda z: (z["kind"] == x["kind"]) & (z["value"] == x["value"]))) == 1)
    counted = values.select(*pair, "form", "n", "level", "place", F.when(F.col("level") == 0, F.col("all_hits")).otherwise(F.col("hits")).alias("hits"), F.size("slots").cast("long").alias("n_slots"), F.size(steady).cast("long").alias("n_consistent"))
    holds = (F.col("hits") >= F.col("n") * similarity) & (F.col("n_consistent") >= F.col("n_slots") * similarity)
    judged = counted.groupBy(*pair, "form").agg(F.min(F.when(holds, F.struct("level", "place", "hits", "n_slots", "n_consistent"))).alias("best")).alias("s")
    joined = p.join(judged, F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.text_hash") == F.col("s.text_hash")) & F.col("p.item_id").eqNullSafe(F.col("s.item_id")) & (F.col("p.form") == F.col("s.form")), "left")
    kept = joined.filter(F.col("s.text_hash").isNull() | F.col("s.best").isNotNull())  # without rows to judge, the windows decide
    found = kept.select("p.doc_id", "p.text_hash", "p.item_id", "p.form", F.col("p.n").cast("long").alias("n"), F.coalesce("s.best.hits", "p.hits").alias("hits"), F.coalesce("s.best.n_slots", F.lit(0)).alias("n_slots"), F.coalesce("s.best.n_consistent", F.lit(0)).alias("n_consistent"))
    literal = literal_pairs(docs, benchmark, items, similarity, item_col, item_text_col)
    if literal is not None:
        found = found.unionByName(literal.select(*pair, F.lit(2).alias("form"), F.col("n").cast("long").alias("n"), "hits", F.lit(0).cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_consistent")))
    first = found.groupBy(*pair).agg(F.min(F.struct("form", "n", "hits", "n_slots", "n_consistent")).alias("x"))
    return first.select(*pair, F.col("x.n").alias("n_windows"), F.col("x.hits").alias("n_hit"), (F.col("x.hits") / F.col("x.n")).alias("coverage"), "x.n_slots", "x.n_consistent")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    bad = written(find_contaminated(docs, benchmark, similarity, id_col, text_col).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated-ids")
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("key_id"), F.xxhash64(text_or_empty(text_col)).alias("key_hash"))
    return keyed.join(bad, keyed.key_id.eqNullSafe(bad.bad_id) & (keyed.key_hash == bad.bad_hash), "left_anti").select("doc.*")
