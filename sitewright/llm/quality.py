"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation estimates from
all documents how accurate each labeller is for good and for bad documents: documents with equal votes are counted
together, so the driver sees at most 3 ** labellers patterns, whatever the corpus. The posteriors then label a
bounded sample of `sample` distinct texts, those of the smallest hashes, so that runs agree and a text that many rows
share is drawn once, with their number as its weight. A linear scorer is trained on it, over hashed features: shapes and
endings of words, and the labellers' figures in steps. The scorer reads every whole text. Gold labels are never read.

Defined results: null and blank texts have no votes and no features, their score is the scorer's intercept and they
are rejected; ids may be null or repeat; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq, itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = 12
SHORT = 12  # words
SIGNS = "#$%&*|<>{}=~^\\@_+"
TAIL = frozenset(SIGNS)
BITS = 16
SAMPLE = 20_000
ENDING, ENDING_SHARE = 3, 0.5  # letters, and the length of their part of the features
#: By class, shares of the votes bad and good that a labeller is presumed to cast.
PRESUMED = {BAD: (0.4, 0.6), GOOD: (0.005, 0.995)}
SCHEMA = "doc_id long, score double, posterior double, accepted boolean"


def measures(text: str) -> dict[str, float]:
    """Plain figures of a whole text."""
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    return {
        "n": len(words),
        "signs": sum(map(text.count, SIGNS)) / max(1, len(text)),
        "bars": text.count("|") / n,
        "bangs": text.count("!!") / n,
        "shouted": sum(map(str.isupper, words)) / n,
        "again": sum(map(eq, words, words[1:])) / n,
        "again_soon": sum(map(eq, words, words[2:])) / n,
        "distinct": len(set(words)) / n,
        "lines_again": 1 - len(set(lines)) / max(1, len(lines)),
        "length": sum(map(len, words)) / n,
        "tails": sum(map(TAIL.__contains__, map(itemgetter(-1), words))) / n,
        "plain": sum(map(str.isalpha, words)) / n,
        "stops": sum(map(text.count, ".!?")) / n,
    }


def _vote(value: float, good: tuple[float, float], bad_above: float = float("inf"), bad_below: float = float("-inf")) -> int:
    if value > bad_above or value < bad_below:
        return BAD
    return GOOD if good[0] <= value <= good[1] else NONE


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """One vote for each labeller; a text of under SHORT words gets none, as shares say little there."""
    long = m["n"] >= 40
    if m["n"] < SHORT:
        return (NONE,) * LABELLERS
    return (
        _vote(m["signs"], (0, 0.005), bad_above=0.03),
        _vote(m["bars"], (0, 0.01), bad_above=0.1),
        _vote(m["bangs"], (0, 0.02), bad_above=0.1),
        _vote(m["shouted"], (0, 0.1), bad_above=0.5),
        _vote(m["again"], (0, 0.02), bad_above=0.1),
        _vote(m["again_soon"], (0, 0.08), bad_above=0.2),
        _vote(m["distinct"], (0.4, 1), bad_below=0.1 if long else 0),
        _vote(m["lines_again"], (0, 0.05), bad_above=0.4),
        _vote(m["length"], (3, 8.2), bad_above=8.6, bad_below=2),
        _vote(m["stops"], (0.03, 0.4), bad_above=0.8, bad_below=0.005 if long else 0),
        _vote(m["tails"], (0, 0.03), bad_above=0.15),
        _vote(m["plain"], (0.6, 1), bad_below=0.55 if long else 0),
    )


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """The share of good documents, and per class, labeller and vote the probability of that vote."""
    seen = list(patterns)
    v = np.array(seen)
    weight = np.array([patterns[p] for p in seen], float)
    good = np.where((v == BAD).any(1), 0.02, np.where((v == GOOD).any(1), 0.98, 0.5))
    # Labellers are presumed better than chance: this many votes of each class are as in PRESUMED.
    presumed = 0.02 * weight.sum()
    for _ in range(rounds):
        share = float((good * weight).sum() / weight.sum())
        table = np.empty((2, v.shape[1], 3))
        for c, part in ((BAD, (1 - good) * weight), (GOOD, good * weight)):
            for k in (BAD, GOOD):
                table[c, :, k] = ((v == k) * part[:, None]).sum(0) + presumed * PRESUMED[c][k] + 0.5
            table[c] /= table[c][:, [BAD, GOOD]].sum(1, keepdims=True)
            table[c, :, NONE] = 1.0  # no vote says nothing of the class
        new = posterior(v, share, table)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return share, table


def posterior(v: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    at = np.arange(v.shape[1])
    logs = [np.log(table[c][at, v]).sum(1) for c in (BAD, GOOD)]
    odds = logs[GOOD] - logs[BAD] + np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


class _Shapes(dict):
    """Letters become A or a, digits 0; everything else stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


RUN = re.compile(r"(.)\1+")


def features(text: str, m: dict[str, float], shapes: _Shapes) -> dict[int, float]:
    """Hashed features: endings of words, shares of word shapes, and the figures in steps."""
    if not m["n"]:
        return {}
    out: dict[int, float] = {}
    endings = Counter([w[-ENDING:] for w in text.split()])
    scale = ENDING_SHARE / max(1, len(endings)) ** 0.5
    for ending in endings:
        h = crc32(b"e" + ending.encode()) & ((1 << BITS) - 1)
        out[h] = out.get(h, 0.0) + scale
    found: Counter[str] = Counter()
    for shape, n in Counter(text.translate(shapes).split()).items():
        found[RUN.sub(r"\1", shape)[:12]] += n  # words of one shape differ little beyond
    for shape, n in found.items():
        h = crc32(b"s" + shape.encode()) & ((1 << BITS) - 1)
        out[h] = out.get(h, 0.0) + n / m["n"]
    for name, value in m.items():
        if name != "n":
            h = crc32(f"{name}={min(20, int(value * 20)) if name != 'length' else min(30, int(value * 2))}".encode()) & ((1 << BITS) - 1)
            out[h] = out.get(h, 0.0) + 1.0
    return out


def train(keys: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels (the last is the intercept), by full-batch AdaGrad. Features are held
    twice, by row and by feature, in 8 bytes each, so sums need no more than one pass over either."""
    bias = 1 << BITS
    sizes = np.array([len(k) + 1 for k in keys])
    col = np.concatenate([np.append(k, bias) for k in keys]).astype(np.int32)
    val = np.concatenate([np.append(v, 1) for v in values]).astype(np.float32)
    used, col = np.unique(col, return_inverse=True)
    col, row = col.astype(np.int32), np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
    by_col = np.argsort(col, kind="stable")
    first_of_row, first_of_col = np.cumsum(sizes) - sizes, np.searchsorted(col[by_col], np.arange(len(used)))
    row, val_by_col = row[by_col], val[by_col]
    del by_col
    share, held = weight / weight.sum(), np.where(used == bias, 0.0, decay)
    w, past = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(steps):
        z = np.add.reduceat(val * w[col], first_of_row)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = np.add.reduceat(val_by_col * err[row], first_of_col) + held * w
        past += g * g
        w -= rate * g / np.sqrt(past)
    out = np.zeros((1 << BITS) + 1)
    out[used] = w
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[float, np.ndarray, np.ndarray]:
    """Share and table of the labellers, from all documents; weights of the scorer, from a bounded sample."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, ...]] = Counter()
        for _, (texts,) in arrow_rows(batches, "text"):
            seen.update(votes(measures(t)) for t in texts)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(["".join(map(str, p)) for p in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch, (texts,) in arrow_rows(batches, "text"):
            keys, values, patterns = [], [], []
            for t in texts:
                m = measures(t)
                f = features(t, m, shapes)
                keys.append(np.fromiter(f, np.int32, len(f)).tobytes())
                values.append(np.fromiter(f.values(), np.float32, len(f)).tobytes())
                patterns.append("".join(map(str, votes(m))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(patterns, pa.string())], names=["h", "n", "keys", "vals", "pattern"])

    texts = docs.select(text_or_empty(text_col).alias("text"))
    counted = texts.mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(map(int, r.pattern)): r.n for r in counted}
    if not patterns:
        return 0.5, np.ones((2, LABELLERS, 3)), np.zeros((1 << BITS) + 1)
    share, table = estimate(patterns)
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    place = F.struct(F.pmod("h", F.lit(1 << 30)).alias("place"), "h")
    for within in (int(min(1.0, 2 * sample / sum(patterns.values())) * (1 << 30)) + 1, 1 << 30):  # all, if few texts are distinct
        near = hashed.filter(F.pmod("h", F.lit(1 << 30)) < within)
        last = near.select(place.alias("at")).distinct().orderBy("at").limit(sample).agg(F.max("at").alias("at"), F.count("*").alias("n")).first()
        if last["n"] == sample:
            break
    drawn = near.filter(place <= F.struct(F.lit(last["at"]["place"]).cast("long").alias("place"), F.lit(last["at"]["h"]).cast("long").alias("h")))
    distinct = drawn.groupBy("h").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    rows = distinct.select("h", "n", "text").mapInArrow(featured, "h long, n long, keys binary, vals binary, pattern string").collect()  # at most `sample`
    rows.sort(key=lambda r: r["h"])
    labels = posterior(np.array([list(map(int, r["pattern"])) for r in rows]), share, table)
    keys, values, counts = [np.frombuffer(r["keys"], np.int32) for r in rows], [np.frombuffer(r["vals"], np.float32) for r in rows], np.array([r["n"] for r in rows], float)
    del rows
    return share, table, train(keys, values, labels, counts)


def score_documents(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, posterior and accepted of every document."""
    share, table, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # half a megabyte, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shapes = shared.value, _Shapes()
        for batch, (texts,) in arrow_rows(batches, "text"):
            ms = [measures(t) for t in texts]
            z = [w[-1] + sum(x * w[k] for k, x in features(t, m, shapes).items()) for t, m in zip(texts, ms, strict=True)]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            accepted = (p >= least) & np.array([m["n"] > 0 for m in ms], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(posterior(np.array([votes(m) for m in ms]).reshape(-1, LABELLERS), share, table)), pa.array(accepted)], names=["doc_id", "score", "posterior", "accepted"])

    return _texts(docs, id_col, text_col).mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The accepted documents, all columns as they were. Rows are judged where they lie; nothing is joined."""
    share, table, weights = fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shapes = shared.value, _Shapes()
        for batch, (texts,) in arrow_rows(batches, text_col):
            good = []
            for t in texts:
                m = measures(t or "")
                z = w[-1] + sum(x * w[k] for k, x in features(t or "", m, shapes).items())
                good.append(m["n"] > 0 and z >= np.log(least / (1 - least)))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
