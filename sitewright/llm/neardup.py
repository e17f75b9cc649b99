"""Near duplicates by improved consistent weighted sampling.

Texts are sets of five-word shingles weighted by TF-IDF: (1 + ln tf) * ln(1 + N / (df + N / 10)). Document frequencies
are counted over all documents in a table of fixed size, indexed by shingle hash; a shingle of few documents shares
its place with others, but such places hold about as many documents per N at any corpus size, far below the N / 10
that smooths the weight. Two texts are near duplicates if their weighted Jaccard similarity is at least `similarity`.

1. Each text draws BANDS * ROWS consistent weighted samples; texts that agree in a whole band meet in its bucket.
   Equal texts are one node from here on.
2. In each bucket the node that meets most others is the pivot, and the others are compared with it (one row each,
   never all pairs). Links come from exact weighted similarities alone, and components from large-star / small-star
   rounds over links.
3. Buckets that still hold several components are compared in blocks. Every node outside a bucket's largest component
   is compared with every node of the bucket's other components, so no link between classes is lost. Both sides are
   dealt by hash into blocks of bounded rows and bytes; a block holds each of its texts once, compares only texts whose
   sums of weights allow the similarity, and gives one link for each pair of components it joins, so neither text pairs
   nor all links are ever rows.

Defined results: a text of one to four words is one shingle of all its words; null, empty and blank texts have none
and are near duplicates only of texts equal to them; ids may be null or repeat (the smallest id that is not null names
the class, and of rows that share it, or of a class without ids, one row stays); an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, removed, text_or_empty, written
from .wordhash import BASES, Powers, Words, chunks, mix

SHINGLE = 5
BANDS, ROWS = 12, 4
TABLE_BITS = 18
DRAWS = 1 << 16
BLOCK_ROWS, BLOCK_BYTES = 1024, 2 << 20  # of each side of a block


class Shingler:
    """Shingles of texts: text number, hash and tf, sorted by text and hash."""

    def __init__(self) -> None:
        self.bytes, self.powers = Powers(BASES[0]), Powers(BASES[1])

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(texts, self.bytes)
        at, hashes = words.runs(SHINGLE, self.powers)
        doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(words.first_word)
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        if len(short):
            total, down = words.sums(self.powers)
            a = words.first_word[short]
            own = mix((total[a + sizes[short]] - total[a]) * down[a] + sizes[short].astype(np.uint64))
            doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])) if len(doc) else np.zeros(0, np.int64)
        return doc[new], hashes[new], np.diff(np.append(new, len(doc)))


def places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def place_weights(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p(n_docs / (frequencies + max(n_docs, 1) / 10))


def weigh(hashes: np.ndarray, tf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * weights[places(hashes)]


class Sampler:
    """Improved consistent weighted sampling: r and c from Gamma(2, 1), beta uniform, all fixed by shingle and draw."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(2010))
        self.r = rng.gamma(2.0, 1.0, DRAWS).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, DRAWS)).astype(np.float32)

    def bands(self, doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have shingles, and their band keys, one column a band."""
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        keys = np.zeros((len(first), BANDS), np.uint64)
        if not len(first):
            return doc, keys
        sizes = np.diff(np.append(first, len(doc)))
        log_w = np.log(weight).astype(np.float32)
        for k in range(BANDS * ROWS):
            x = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            r = self.r[(x & np.uint64(0xFFFF)).astype(np.int64)]
            beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1)
            best = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, first), sizes))
            owner = doc[best]
            best = best[np.concatenate([[True], owner[1:] != owner[:-1]])]  # of ties the smallest hash
            sample = mix(hashes[best] ^ mix(t[best].astype(np.int64).astype(np.uint64) + np.uint64(k)))
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(31) + sample + np.uint64(k // ROWS))
        return doc[first], keys


def similarities(a: list[bytes], b: list[bytes], shingler: Shingler, weights: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair a[i], b[i]; 0 where neither has shingles."""
    n = len(a)
    doc, hashes, tf = shingler.shingles(a + b)
    w = weigh(hashes, tf, weights)
    order = np.lexsort((hashes, doc % n))
    doc, hashes, w = doc[order] % n, hashes[order], w[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1]))
    low = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), n)
    total = np.bincount(doc, w, n)
    return low / np.maximum(total - low, 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The table of document frequencies, and the number of documents. Each task sums its own table; tables are added
    in slices, so no task and no transfer is larger than one table."""
    slices = 16
    width = (1 << TABLE_BITS) // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, n = Shingler(), np.zeros(1 << TABLE_BITS, np.int64), 0
        for _, (rows,) in arrow_rows(batches, "text"):
            n += len(rows)
            for _, run in chunks(rows):
                doc, hashes, _ = shingler.shingles(run)
                total += np.bincount(np.unique(doc << TABLE_BITS | places(hashes)) & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)
        if n:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "n": pa.array([n if k == 0 else 0 for k in range(slices)], pa.int64()), "counts": pa.array([total[k * width : (k + 1) * width].tobytes() for k in range(slices)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, rows in arrow_rows(batches, "slice", "n", "counts"):
            for k, n, counts in zip(*rows, strict=True):
                own = found.setdefault(k, [0, np.zeros(width, np.int64)])
                own[0] += n
                own[1] += np.frombuffer(counts, np.int64)
        if found:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(found), pa.int32()), "n": pa.array([x[0] for x in found.values()], pa.int64()), "counts": pa.array([x[1].tobytes() for x in found.values()], pa.binary())})

    schema = "slice int, n long, counts binary"
    parts = texts.mapInArrow(count, schema)
    merged = parts.withColumn("group", F.spark_partition_id() % 64).repartition("slice", "group").drop("group").mapInArrow(add, schema).repartition(slices, "slice").mapInArrow(add, schema)
    table, n = np.zeros(1 << TABLE_BITS, np.int64), 0
    for r in merged.collect():
        table[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(r["counts"], np.int64)
        n += r["n"]
    return table, n


def band_rows(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, node (key of the text), bands and a row number of each document (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a table of fixed size

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(), Sampler()
        for batch, (texts,) in arrow_rows(batches, "text"):
            out: list[list[int] | None] = [None] * len(texts)
            for first, run in chunks(texts):
                doc, hashes, tf = shingler.shingles(run)
                owner, keys = sampler.bands(doc, hashes, weigh(hashes, tf, shared.value))
                for k, row in zip(owner.tolist(), keys.view(np.int64).tolist(), strict=True):
                    out[first + k] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "node", "row", "bands"])

    return docs.select("doc_id", F.unhex(F.md5("text")).alias("node"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(sample, "doc_id long, node binary, row long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for the nodes of edges (a, b), by large-star and small-star rounds."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    spark, edges, before = edges.sparkSession, written(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large")
        large = written(both.join(first, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = large.join(least, "a").select("a", "b", "m")
        small = written(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        for done in (edges, first, large, least):
            removed(spark, done)
        edges = small
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def compared(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are near duplicates."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch, (left, right) in arrow_rows(batches, "ta", "tb"):
            good: list[np.ndarray] = []
            i = 0
            while i < len(left):
                j, size = i, 0
                while j < len(left) and (size < 1 << 20 or j == i):
                    size += len(left[j]) + len(right[j])
                    j += 1
                good.append(similarities([t.encode() for t in left[i:j]], [t.encode() for t in right[i:j]], shingler, shared.value) >= similarity - 1e-9)
                i = j
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    one, two = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary")


def joining_links(group: np.ndarray, is_pivot: np.ndarray, root: np.ndarray, texts: list[bytes], shingler: Shingler, weights: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Row numbers of links between pivots and members of one group that join different roots; rows are sorted by
    group, pivots first, and each text has shingles."""
    doc, hashes, tf = shingler.shingles(texts)
    w = weigh(hashes, tf, weights)
    codes = np.unique(hashes, return_inverse=True)[1]
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    total = np.add.reduceat(w, at[:-1])
    one = np.zeros(len(codes))  # a pivot's weights, by code
    out = []
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for first, end in zip(starts, np.append(starts[1:], len(group)), strict=True):
        middle = first + int(is_pivot[first:end].sum())
        if middle in (first, end):
            continue
        label = root[first:end].copy()
        # members by weight: only those between similarity * and 1 / similarity * a pivot's weight can be near it
        order = np.argsort(total[middle:end], kind="stable") + middle
        sizes, sums, own = at[order + 1] - at[order], total[order], label[order - first]
        cuts = np.cumsum(sizes) - sizes
        places = np.repeat(at[order] - cuts, sizes) + np.arange(sizes.sum())
        c, v = codes[places], w[places]
        for i in range(first, middle):
            mine = label[i - first]
            lo = int(np.searchsorted(sums, total[i] * (similarity - 1e-9), "left"))
            hi = int(np.searchsorted(sums, total[i] / (similarity - 1e-9), "right"))
            if lo == hi or (own[lo:hi] == mine).all():
                continue
            held = slice(at[i], at[i + 1])
            one[codes[held]] = w[held]
            span = slice(cuts[lo], cuts[hi - 1] + sizes[hi - 1])
            low = np.add.reduceat(np.minimum(one[c[span]], v[span]), cuts[lo:hi] - cuts[lo])
            one[codes[held]] = 0
            near = low >= (similarity - 1e-9) * (total[i] + sums[lo:hi] - low)
            for j in (np.flatnonzero(near & (own[lo:hi] != mine)) + lo).tolist():
                if own[j] != mine:
                    out.append((i, int(order[j])))
                    merged = own[j]
                    label[label == merged] = mine
                    own[own == merged] = mine
    return out


def block_links(placed: DataFrame, texts: DataFrame, weights: np.ndarray, similarity: float, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that join roots within buckets. placed: bucket, node, root, waiting, n_bytes; the waiting nodes of a
    bucket are compared with all its nodes of other roots."""
    shared = placed.sparkSession.sparkContext.broadcast(weights)
    parts = lambda rows, size: F.ceil(F.greatest(rows / block_rows, size / block_bytes)).cast("int")
    waits, size = F.col("waiting").cast("long"), F.col("n_bytes")
    cut = placed.groupBy("bucket").agg(parts(F.sum(waits), F.sum(waits * size)).alias("np"), parts(F.count("*"), F.sum(size)).alias("nq"))
    dealt = placed.join(written(cut, "blocks"), "bucket")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pivots = dealt.filter("waiting").select("bucket", own(F.col("np")).alias("p"), every("nq").alias("q"), F.lit(0).alias("side"), "node", "root")
    members = dealt.select("bucket", every("np").alias("p"), own(F.col("nq")).alias("q"), F.lit(1).alias("side"), "node", "root")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, held_bytes = Shingler(), [], 0

        def links(rows: pa.Table) -> pa.RecordBatch:
            keys = [rows.column(n).to_numpy() for n in ("bucket", "p", "q")]
            group = np.cumsum(np.concatenate([[False], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
            node, root = rows.column("node").to_pylist(), rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
            found = joining_links(group, rows.column("side").to_numpy() == 0, root, [t.encode() for t in rows.column("text").to_pylist()], shingler, shared.value, similarity)
            return pa.RecordBatch.from_pydict({"a": pa.array([node[i] for i, _ in found], pa.binary()), "b": pa.array([node[j] for _, j in found], pa.binary())})

        for batch in released(batches):
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                held.append(piece)
                held_bytes += sum(map(len, piece.column(6).to_pylist()))
                if held_bytes < block_bytes:
                    continue
                rows = pa.Table.from_batches(held)
                last = [rows.column(n).to_numpy() for n in ("bucket", "p", "q")]
                whole = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in last]))[-1:].sum() + 1) if any((k != k[-1]).any() for k in last) else 0
                if whole:  # rows of groups that have ended
                    yield links(rows.slice(0, whole))
                    rows = rows.slice(whole)
                held, held_bytes = rows.to_batches(), sum(map(len, rows.column("text").to_pylist()))
        if held and sum(b.num_rows for b in held):
            yield links(pa.Table.from_batches(held))

    rows = written(pivots.unionByName(members), "dealt").join(texts.select("node", "text"), "node").select("bucket", "p", "q", "side", "node", "root", "text")
    return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "side").mapInArrow(compare, "a binary, b binary")


def near_classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, class_id, class_size and kept for every document; node is the key of its text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    frequencies, n_docs = document_frequencies(docs.select("text"))
    weights = place_weights(frequencies, n_docs)
    rows = written(band_rows(docs, weights), "bands")
    nodes = rows.filter("bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("first_id"))
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    met = written(spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = written(spread.join(met, "bucket"), "members")
    degree = written(members.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    members = written(members.drop("size").join(degree, "node"), "met")
    # Copies become one row where they lie, before they move; always a merge join, as what meets grows with the corpus,
    # so texts are dealt by node once for aggregation and join.
    keyed = docs.select("text", F.unhex(F.md5("text")).alias("node")).groupBy("node").agg(F.first("text").alias("text"))
    texts = written(keyed.join(degree.select("node").hint("merge"), "node", "left_semi").withColumn("n_bytes", F.octet_length("text")), "texts")

    # first pivots: the node of a bucket that meets most others
    top = written(members.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("pivot")), "pivots")
    pairs = members.join(top, "bucket").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = written(compared(pairs, texts, weights, similarity), "links")
    roots = written(components(links), "roots")

    # buckets of two nodes are done; in others that hold several components, all but the largest wait
    placed = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("nodes"))
    mixed = written(mixed.filter("parts > 1 AND nodes > 2").select("bucket", F.col("largest.root").alias("main")), "mixed")
    placed = placed.join(mixed, "bucket").join(texts.select("node", "n_bytes"), "node").select("bucket", "node", "root", (F.col("root") != F.col("main")).alias("waiting"), "n_bytes")
    more = written(block_links(written(placed, "placed"), texts, weights, similarity), "more-links")
    if not more.isEmpty():
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")

    # classes from one row a node; the documents then meet their node's class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    own = rows.groupBy("node").agg(first.alias("first"), F.count("*").alias("n")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "n")
    own = written(own, "nodes")
    classes = written(own.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("class_size")), "classes")
    named = written(own.select("node", "root").join(classes, "root").select("node", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.row").alias("kept_row")), "named")
    return rows.select("doc_id", "node", "row").join(named, "node").select("doc_id", "node", "class_id", "class_size", (F.col("row") == F.col("kept_row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, all columns as they were. Rows move once: joining and telling apart rows that agree in
    id and text go by one key."""
    key = lambda node, row_id: F.concat_ws(":", F.hex(node), F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("-"))).alias("key")
    kept = written(near_classes(docs, similarity, id_col, text_col).filter("kept").select(key(F.col("node"), F.col("doc_id"))), "kept")
    keyed = docs.select(F.struct("*").alias("doc"), key(F.unhex(F.md5(text_or_empty(text_col))), F.col(id_col).cast("long")))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
