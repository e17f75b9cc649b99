"""Substring dedup: repeats of at least `window` words anywhere in the corpus.

The repeats are the deep internal nodes of a suffix tree over words: nodes at depth `window` with two leaves or more. The
tree is cut into subtrees by prefixes of varying length, and each subtree is built in the memory of one task.

1. Of each window the suffixes are dealt by a first prefix, the window's smallest run of SEED words (by hash). Equal
   windows have the same one at the same offset, so no repeat is lost, and about one suffix in twelve words stands for
   all windows around it: a segment. Prefixes that occur once are leaves and are dropped.
2. Segments equal in all words (by length and a 128-bit digest of the words) are one path; if there are two or more,
   all their windows repeat. Of the other segments those whose prefix has no second path are leaves.
3. What is left goes to subtrees, one row for each path with its words. A prefix that more than GROUP paths share is
   lengthened: its windows are dealt one by one by their first LONGER words, and those of groups that are still too large
   by all their words, which makes each group one node. The other groups are built whole: suffixes are ranked by prefix
   doubling over exact word numbers, and windows of equal rank are the leaves of one node. No hash decides there.

Paths are counted with sums before they move, so a passage that a third of all rows share loads no task. Counts come
back to rows by a broadcast of the hottest keys, whose number is bounded, and by a shuffle for the others. Texts move
once: they are held in a table bucketed by row, which later steps join where it lies.

Defined results: a null text has no words; ids may be null or repeat (rows equal in id and text are occurrences of
their own); texts are read whole, of any length; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bucketed, counted_twice, released, text_or_empty, written
from .wordhash import BASES, Powers, Words, chunks

SEED = 8
LONGER = 16
GROUP = 20_000  # paths or windows of one subtree; a path is at most 2 * window words
TASK_BYTES = 4 << 20  # of paths that a task builds subtrees of at once, unless one group has more
WINDOW = 35
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Of each stretch of `width` values the place of the smallest, the leftmost of equals; by doubling."""
    value, place, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        size += step
    return place


class Cutter:
    """Cuts texts into segments: the windows that share a seed, from word a on, m of them."""

    def __init__(self, window: int = WINDOW, seed: int = SEED) -> None:
        self.window, self.seed = window, min(seed, window)
        self.bytes, self.one = Powers(BASES[0]), Powers(BASES[0])

    def words(self, texts: list[bytes]) -> Words:
        """The words, with one space between them."""
        return Words([b" ".join(t.split()) for t in texts], self.bytes)

    def segments(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed hash, first word and number of windows of each segment."""
        n, none = len(words.hash), np.zeros(0, np.int64)
        if n < self.window:
            return none.astype(np.uint64), none, none
        seeds = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        at, hashes = words.runs(self.seed, self.one)
        seeds[at] = hashes
        starts = np.flatnonzero(words.doc[self.window - 1 :] == words.doc[: n - self.window + 1])
        if not len(starts):
            return none.astype(np.uint64), none, none
        place = smallest(seeds[: n - self.seed + 1], self.window - self.seed + 1)[starts]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        return seeds[place[new]], starts[new], np.diff(np.append(new, len(starts)))

    def parts(self, words: Words, a: np.ndarray, m: np.ndarray) -> list[bytes]:
        """The words of segments."""
        data = words.data
        return [data[i:j] for i, j in zip(words.start[a].tolist(), words.end[a + m + self.window - 2].tolist(), strict=True)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _spread(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """a, a + 1, ... (m of them) for each pair."""
    return np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated(paths: list[bytes], m: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """For each window of the paths (m[i] windows of path i, which stands for n[i] segments) whether its node has two
    leaves or more. Suffixes are ranked by their first 1, 2, 4, ... words, at last by `window` words."""
    split = [p.split(b" ") for p in paths]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array([w for p in split for w in p], pa.binary()).dictionary_encode()
    sorted_words = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
    order = np.empty(len(sorted_words), np.int64)
    order[sorted_words] = np.arange(len(sorted_words))
    rank, length = order[coded.indices.to_numpy()], 1

    def longer(at: np.ndarray, step: int) -> np.ndarray:
        return np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + step], return_inverse=True)[1]

    while 2 * length <= window:
        rank, length = longer(np.arange(len(rank) - length), length), 2 * length
    starts = _spread(np.cumsum(sizes) - sizes, m)
    if length < window:
        rank = longer(starts, window - length)
    else:
        rank = rank[starts]
    return np.bincount(rank, np.repeat(n, m))[rank] >= 2


def subtrees(paths: DataFrame, window: int) -> DataFrame:
    """doc_id, row_key, a, m: runs of windows whose nodes have several leaves, of paths that stand for one segment.
    paths: prefix, n, doc_id, row_key, a, m, words; the paths of one prefix fit in memory."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "a", "m"]

        def nodes(rows: pa.Table) -> pa.RecordBatch:
            m, n = rows.column("m").to_numpy(), rows.column("n").to_numpy()
            again = repeated(rows.column("words").to_pylist(), m, n, window) & (np.repeat(n, m) == 1)
            of, at = np.repeat(np.arange(len(m)), m), _spread(np.zeros(len(m), np.int64), m)
            of, at = of[again], at[again]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])) if len(of) else of
            found = rows.select(["doc_id", "row_key", "a"]).take(pa.array(of[first])).combine_chunks()
            a = found.column("a").to_numpy() + at[first]
            return pa.RecordBatch.from_arrays([*(found.column(k).combine_chunks() for k in names[:2]), pa.array(a.astype(np.int32)), pa.array(np.diff(np.append(first, len(of))).astype(np.int32))], names=names)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in released(batches):
            held.append(batch)
            size += batch.nbytes
            if size < TASK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            prefix = rows.column("prefix").to_numpy()
            whole = int(np.flatnonzero(prefix != prefix[-1])[-1:].sum() + 1) if prefix[0] != prefix[-1] else 0
            if whole:  # groups that have ended
                yield nodes(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield nodes(pa.Table.from_batches(held))

    return paths.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(build, "doc_id long, row_key long, a int, m int")


def deep_windows(paths: DataFrame, window: int, group: int = GROUP) -> DataFrame:
    """What subtrees() gives, of paths whose prefixes may be shared by any number of them."""
    large = written(paths.groupBy("prefix").agg(F.count("*").alias("size")).filter(F.col("size") > group).select("prefix"), "large-prefixes")
    found = subtrees(paths.join(large, "prefix", "left_anti"), window)
    if large.isEmpty():
        return found

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (m, paths) in arrow_rows(batches, "m", "words"):
            split = [p.split(b" ") for p in paths]
            of = np.repeat(np.arange(len(m)), m)
            at = _spread(np.zeros(len(m), np.int64), np.array(m, np.int64))
            parts = [b" ".join(split[i][j : j + window]) for i, j in zip(of.tolist(), at.tolist(), strict=True)]
            prefixes = [int.from_bytes(digest(b" ".join(split[i][j : j + LONGER]))[:8], "little", signed=True) for i, j in zip(of.tolist(), at.tolist(), strict=True)]
            n, doc_id, row_key, a = (batch.column(batch.schema.get_field_index(k)).take(pa.array(of)) for k in ("n", "doc_id", "row_key", "a"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefixes, pa.int64()), pa.array(map(digest, parts), pa.binary()), n, doc_id, row_key, pa.array((a.to_numpy() + at).astype(np.int32)), pa.array(np.ones(len(of), np.int32)), pa.array(parts, pa.binary())],
                names=["prefix", "node", "n", "doc_id", "row_key", "a", "m", "words"],
            )

    schema = "prefix long, node binary, n long, doc_id long, row_key long, a int, m int, words binary"
    longer = written(paths.join(large, "prefix", "left_semi").mapInArrow(windows, schema), "longer-prefixes")
    larger = written(longer.groupBy("prefix").agg(F.count("*").alias("size")).filter(F.col("size") > group).select("prefix"), "larger-prefixes")
    found = found.unionByName(subtrees(longer.join(larger, "prefix", "left_anti").drop("node"), window))
    single = longer.join(larger, "prefix", "left_semi").drop("words")
    nodes = written(single.groupBy("node").agg(F.sum("n").alias("leaves")).filter("leaves > 1").select("node"), "nodes")
    return found.unionByName(single.filter("n = 1").join(nodes, "node", "left_semi").select("doc_id", "row_key", "a", "m"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for) of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))

    # 1. first prefixes: only their hashes move; then texts meet those of their prefixes that recur
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window)
        for _, (texts, keys) in arrow_rows(batches, "text", "row_key"):
            for first, run in chunks(texts):
                words = cutter.words(run)
                seed, a, _ = cutter.segments(words)
                yield pa.RecordBatch.from_arrays([_signed(seed), pa.array(np.array(keys, np.int64)[first + words.doc[a]])], names=["seed", "row_key"])

    prefixes = written(docs.select("text", "row_key").mapInArrow(seeds, "seed long, row_key long"), "prefixes")
    again = written(prefixes.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"), "seeds")
    of_rows = counted_twice(prefixes, again, "seed").groupBy("row_key").agg(F.collect_set("seed").alias("seeds"))
    held = bucketed(docs.join(of_rows, "row_key", "left").select("row_key", "doc_id", "text", "seeds"), "row_key", "held")

    # 2. segments of recurring prefixes, and their paths
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window)
        for batch, (texts, keys) in arrow_rows(batches, "text", "row_key"):
            ids, lists = batch.column(1).to_pylist(), batch.column(3)
            for first, run in chunks(texts):
                words = cutter.words(run)
                seed, a, m = cutter.segments(words)
                doc = words.doc[a]
                wanted = np.zeros(len(a), bool)
                bounds = np.searchsorted(doc, np.arange(len(run) + 1))
                for k in range(len(run)):
                    wanted[bounds[k] : bounds[k + 1]] = np.isin(seed[bounds[k] : bounds[k + 1]].view(np.int64), lists[first + k].values.to_numpy())
                seed, a, m, doc = seed[wanted], a[wanted], m[wanted], doc[wanted]
                yield pa.RecordBatch.from_arrays(
                    [_signed(seed), pa.array(map(digest, cutter.parts(words, a, m)), pa.binary()), pa.array([ids[first + k] for k in doc.tolist()], pa.int64()), pa.array(np.array(keys, np.int64)[first + doc]), pa.array((a - words.first_word[doc]).astype(np.int32)), pa.array(m.astype(np.int32))],
                    names=["prefix", "path", "doc_id", "row_key", "a", "m"],
                )

    segments = held.filter("seeds IS NOT NULL").mapInArrow(cut, "prefix long, path binary, doc_id long, row_key long, a int, m int")
    segments = written(segments, "segments")
    paths = segments.groupBy("prefix", "path").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "row_key", "a", "m")])
    paths = written(paths, "paths")
    whole = counted_twice(segments, paths.select("path", "n"), "path").select("doc_id", "row_key", "a", "m")

    # 3. subtrees of prefixes with several paths
    several = written(paths.groupBy("prefix").agg(F.count("*").alias("ways")).filter("ways > 1").select("prefix"), "several")
    asked = paths.join(several, "prefix", "left_semi").groupBy("row_key").agg(F.collect_list(F.struct("doc_id", "prefix", "n", "a", "m")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, keys, texts, wanted) in arrow_rows(batches, "doc_id", "row_key", "text", "asked"):
            rows = [(r["prefix"], r["n"], doc_id, row_key, r["a"], r["m"], b" ".join(words[r["a"] : r["a"] + r["m"] + window - 1])) for doc_id, row_key, text, found in zip(ids, keys, texts, wanted, strict=True) for words in [text.encode().split()] for r in found if r["doc_id"] == doc_id]
            if rows:
                kinds = {"prefix": pa.int64(), "n": pa.int64(), "doc_id": pa.int64(), "row_key": pa.int64(), "a": pa.int32(), "m": pa.int32(), "words": pa.binary()}
                yield pa.RecordBatch.from_pydict({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*rows, strict=True), strict=True)})

    # rows equal in id and text share what is asked of them: one of them answers
    owners = held.join(asked, "row_key").select("doc_id", "row_key", "text", "asked").dropDuplicates(["row_key", "doc_id"])
    words = written(owners.mapInArrow(fetch, "prefix long, n long, doc_id long, row_key long, a int, m int, words binary"), "path-words")
    spans = whole.unionByName(deep_windows(words, window, group))
    of_docs = spans.groupBy("row_key").agg(F.collect_set(F.struct("doc_id", "a", "m")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (ids, texts, all_spans) in arrow_rows(batches, "doc_id", "text", "spans"):
            n, removed, sha, kept = [], [], [], []
            for doc_id, text, spans in zip(ids, texts, all_spans, strict=True):
                words = text.encode().split()
                spans = [s for s in spans or () if s["doc_id"] == doc_id]
                n.append(len(words))
                gone = 0
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    a, m = (np.array([s[k] for s in spans], np.int64) for k in ("a", "m"))
                    np.add.at(change, a, 1)
                    np.add.at(change, a + m + window - 1, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                removed.append(gone)
                data = b" ".join(words)
                sha.append(hashlib.sha256(data).hexdigest())
                kept.append(data.decode() if with_text else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    schema = RESULT + (", kept_text string" if with_text else "")
    return held.join(of_docs, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)
