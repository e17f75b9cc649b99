"""Toxicity by a noisy channel.

Disguised words (digits and signs for letters, letters spread by separators, drawn-out letters) are seen as a clean
word sent through a noisy channel. A character language model, counted over all documents, and the channel's costs
give the most likely clean word by Viterbi search over the lattice of readings; all states are kept. The restored
words stand beside the words as written, and both are scored by a linear model over words and word beginnings, learnt
from a bounded sample of labelled documents.

A lattice is built for each piece of letters and signs that has a letter, and a sign or a letter three times in a row;
for single letters spread by one to three separators, where the model also places the edges of words. Signs that stand
for nothing may be dropped at a cost. More than MOST_SIGNS signs in a row stand for no letters: words end there. Each
distinct piece between blanks is read once a task, and a lattice takes time in proportion to its length.

The model's character counts grow with the corpus and are summed before they meet; the driver gets at most
SYMBOLS ** 3 of them. Which rows may be learnt from is the caller's filter. The sample of labels (`sample` rows) is
drawn by the hash of the id, so runs agree; at most `marks` words and beginnings are weighted.

Defined results: null and empty texts score as texts without any evidence; ids may be null or repeat; a document whose
id has several labels counts once for each; an empty table gives no rows; other columns are left alone. Words of more
than LONG_WORD letters count by their beginnings alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty, written

SYMBOLS = 64  # 0: edge of a word, 63: any other letter
SAMPLE = 20_000
#: What a sign may stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
COST = 1.0  # of reading a sign as a letter, in nats
DROP = 8.0  # of reading a sign as nothing
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöùúûüÿœøåãõ"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)} | {" ": 0}
MOST_SIGNS = 8
LONG_WORD = 40

SIGN = r"0-9@$!|+(€£*#"
#: Three or more single letters or signs, one to three separators between them.
SPREAD = re.compile(rf"(?<![^\W_])(?:[^\W_]|[@$!|+(€£])(?:(?:[^\w\n]|_){{1,3}}(?:[^\W_]|[@$!|+(€£])(?![^\W_])){{2,}}")
SEPARATORS = re.compile(rf"[^\w{SIGN}]+|_+")
PIECE = re.compile(rf"(?:[^\W\d_]|[{SIGN}])+")
NO_WORD = re.compile(rf"[{SIGN}]{{{MOST_SIGNS + 1},}}")
LETTER = re.compile(r"[^\W\d_]")
NOISE = re.compile(rf"[{SIGN}]|(.)\1\1", re.S)
RUNS = re.compile(r"(.)\1*", re.S)
WORD = re.compile(r"[^\W\d_]+")
ALPHABETIC = np.array([CODE.get(chr(i).lower(), SYMBOLS - 1) if chr(i).isalpha() else 0 for i in range(0x250)], np.uint8)
BEGINNINGS = (4, 5, 6, 7)
MARKS = 4096
REMEMBERED = 200_000  # pieces that a task keeps; all are forgotten beyond that


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter triples; all that is not a letter is the edge of a word."""
    data = np.frombuffer(" ".join(texts).encode("utf-32-le"), "<u4")
    code = np.where(data < len(ALPHABETIC), ALPHABETIC[np.minimum(data, len(ALPHABETIC) - 1)], np.where(data > 0x24F, SYMBOLS - 1, 0)).astype(np.int64)
    return np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3) if len(code) > 2 else np.zeros(SYMBOLS**3, np.int64)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), triples smoothed by pairs."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    pairs = c.sum(0) + 0.01
    lower = pairs / pairs.sum(1, keepdims=True)
    return -np.log((c + 5.0 * lower[None]) / (c.sum(2, keepdims=True) + 5.0))


class Restorer:
    """Clean readings of disguised words."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.reshape(SYMBOLS * SYMBOLS, SYMBOLS).tolist()

    def options(self, c: str, n: int, edges: bool) -> list[tuple[str, list[int], float]]:
        """What a run of n signs c may stand for: letters, their codes, and the channel's cost."""
        found = []
        for letter in c if c.isalpha() else READINGS.get(c, ""):
            noise = 0.0 if letter == c else COST
            found.append((letter, noise + (0.3 if n > 1 else 0.0)))
            if n > 1:
                found.append((letter * 2, noise + (0.3 if n > 2 else 0.0)))
        if edges:
            found += [(" " + letters, noise) for letters, noise in found]
        if not c.isalpha():
            found.append(("", DROP))
        return [(letters, [CODE.get(x, SYMBOLS - 1) for x in letters], noise) for letters, noise in found]

    def word(self, noisy: str, spread: bool = False) -> str:
        """The best reading, by Viterbi search over the last two letters; with `spread` it may be several words. What
        all paths share is put out as soon as one state is left, so no lattice is held longer than it is in doubt."""
        cost, out = self.cost, []
        states: dict[int, float] = {0: 0.0}
        trail: list[dict[int, tuple[int, str]]] = []
        for k, m in enumerate(RUNS.finditer(noisy)):
            new: dict[int, float] = {}
            back: dict[int, tuple[int, str]] = {}
            options = self.options(m[1], len(m[0]), spread and k > 0)
            for state, sum_ in states.items():
                for letters, codes, noise in options:
                    at, total = state, sum_ + noise
                    for z in codes:
                        total += cost[at][z]
                        at = (at & (SYMBOLS - 1)) * SYMBOLS + z
                    if at not in new or total < new[at]:
                        new[at], back[at] = total, (state, letters)
            states = new
            trail.append(back)
            if len(new) == 1:
                out.append(self._path(trail, next(iter(new))))
                trail = []
        if trail:
            out.append(self._path(trail, min(states, key=lambda at: states[at] + cost[at][0])))
        return "".join(out)

    @staticmethod
    def _path(trail: list[dict[int, tuple[int, str]]], at: int) -> str:
        letters = []
        for back in reversed(trail):
            at, found = back[at]
            letters.append(found)
        return "".join(reversed(letters))


def marks_of(words: Iterable[str]) -> set[str]:
    """Words and their beginnings."""
    words = set(words)
    found = {w for w in words if len(w) <= LONG_WORD}
    for n in BEGINNINGS:
        found.update(w[:n] + "-" for w in words if len(w) > n)
    return found


class Reader(dict):
    """Pieces between blanks -> what is wanted of their marks; read when first met."""

    def __init__(self, cost: np.ndarray, wanted: dict[str, float] | None = None) -> None:
        super().__init__()
        self.restorer, self.wanted = Restorer(cost), wanted

    def words(self, piece: str) -> list[str]:
        """The words of a piece as written, and as restored."""
        low = piece.lower()
        found = WORD.findall(low)
        if NOISE.search(low):
            for run in PIECE.findall(low):
                found += [w for part in NO_WORD.split(run) if part and LETTER.search(part) and NOISE.search(part) for w in WORD.findall(self.restorer.word(part))]
        return found

    def chosen(self, words: Iterable[str]) -> tuple[str, ...]:
        marks = marks_of(words)
        return tuple(marks if self.wanted is None else marks & self.wanted.keys())

    def __missing__(self, piece: str) -> tuple[str, ...]:
        found = self.chosen(self.words(piece))
        if len(piece) <= 4 * LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found

    def marks(self, text: str) -> set[str]:
        """The marks of a whole text."""
        found = set().union(*filter(None, map(self.__getitem__, set(text.split()))))
        for m in SPREAD.finditer(text):
            run = SEPARATORS.sub("", m[0]).lower()
            if LETTER.search(run):
                found.update(self.chosen(w for part in NO_WORD.split(run) if part for w in self.restorer.word(part, spread=True).split()))
        return found


def select_features(counts: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log odds of the features that mark toxic documents beyond chance."""
    out = {}
    for name, c1, c0 in counts:
        p1, p0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
        out[name] = float(np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0)))
    return out


def figures(found: set[str], weights: dict[str, float]) -> tuple[float, float, float]:
    """How strong the strongest marks of a text are, and how many there are."""
    hits = sorted(map(weights.__getitem__, found), reverse=True)
    return (hits[0] if hits else 0.0, sum(hits[:8]), float(np.log1p(len(hits))))


def fit_scorer(rows: list[tuple[tuple[float, float, float], int]], steps: int = 2000, rate: float = 0.3) -> list[float]:
    x = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    x = np.hstack([x, np.ones((len(x), 1))])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    w, g2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        g = (x / scale).T @ (1 / (1 + np.exp(-np.clip((x / scale) @ w, -40, 40))) - y) / len(y) + 1e-4 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return (w / scale).tolist()


def count_letters(texts: DataFrame) -> np.ndarray:
    """Letter triples of all documents. Every task sums its own, so what moves is bounded a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for _, (rows,) in arrow_rows(batches, "text"):
            for i in range(0, len(rows), 256):
                total += letter_counts(rows[i : i + 256])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"triple": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in texts.mapInArrow(count, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect():
        counts[r.triple] = r.n
    return counts


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE, marks: int = MARKS) -> tuple[np.ndarray, dict[str, float], list[float]]:
    """The language model, the weights of the marks, and the scorer. docs: doc_id, text. labels: doc_id, toxic.
    learnable: which label rows may be used. The sample of labels is bounded, so it is broadcast."""
    spark = docs.sparkSession
    cost = language_model(count_letters(docs))
    usable = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    drawn = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample), "labels")
    train = written(docs.join(F.broadcast(drawn), "doc_id"), "labelled")  # at most `sample` rows
    shared = spark.sparkContext.broadcast(cost)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        both: tuple[Counter, Counter] = (Counter(), Counter())
        for _, (texts, toxic) in arrow_rows(batches, "text", "toxic"):
            for t, y in zip(texts, toxic, strict=True):
                both[1 if y else 0].update(reader.marks(t))
                both[1 if y else 0][""] += 1  # counts the documents
        names = list(both[0] | both[1])
        yield pa.RecordBatch.from_pydict({"mark": pa.array(names, pa.string()), "c1": pa.array([both[1][n] for n in names], pa.int64()), "c0": pa.array([both[0][n] for n in names], pa.int64())})

    # only what occurs in toxic documents can be a mark; its count among the others is needed too
    counted = written(train.mapInArrow(count, "mark string, c1 long, c0 long").groupBy("mark").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).filter("c1 >= 3 OR mark = ''"), "marks")
    sizes = counted.filter("mark = ''").first()
    n1, n0 = (sizes.c1, sizes.c0) if sizes else (0, 0)
    if not n1 or not n0:
        return cost, {}, [0.0, 0.0, 0.0, -4.0]
    expected = (F.col("c1") + F.col("c0")) * (n1 / (n1 + n0))
    surprise = (F.col("c1") - expected) / F.sqrt(expected * (n0 / (n1 + n0)) + 0.5)
    top = counted.filter("mark <> ''").withColumn("z", surprise).filter("z > 5 AND c1 > 2 * c0 * " + repr(n1 / n0)).orderBy(F.desc("z"), "mark").limit(marks).collect()
    weights = select_features([(r["mark"], r["c1"], r["c0"]) for r in top], n1, n0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, weights)
        for batch, (texts,) in arrow_rows(batches, "text"):
            found = [list(figures(reader.marks(t), weights)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = train.mapInArrow(measured, "toxic int, x array<double>").collect()
    return cost, weights, fit_scorer(sorted((tuple(r["x"]), r["toxic"]) for r in rows))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, dict[str, float], list[float]], threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for each of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS ** 3 costs and a bounded number of marks

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, weights, w = shared.value
        reader = Reader(cost, weights)
        for batch, (texts,) in arrow_rows(batches, "text"):
            x = np.array([figures(reader.marks(t), weights) for t in texts], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(w[:3]) + w[3], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.mapInArrow(score, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    model = fit(texts, labels, ~held_out(F.col("doc_id")), sample)
    return score_documents(texts, model, threshold).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
