"""Shards of near equal size by best-fit decreasing.

Equal texts form one indivisible group. Best fit takes the groups by falling size and puts each into the bin with the
least room that still holds it, found in a balanced tree of the rooms.

That is sequential work, so it is done in two levels, neither of which sees an unbounded list. A group above
total / (shards * grain) is an item of its own; there are fewer than shards * grain of them. Smaller groups are first
packed by the same rule into packets of that size, hash bucket by hash bucket, as a stream of sorted rows. All but
one packet of a bucket are more than half full, so packets number at most 2 * shards * grain + buckets. The driver
packs these items, and searches for the smallest capacity at which the wanted number of shards suffices. A group
larger than an even share gets a shard of its own and the others share the rest evenly.

Defined results: a null text counts as the empty text; a null id is an id like others; repeated rows are rows; an
empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import text_or_empty, written


class RoomTree:
    """A treap of (room, bin): smallest entry at or above a room, in logarithmic time. Priorities come from a fixed
    mixer, so equal input gives an equal tree."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.count = 0

    def _priority(self) -> int:
        self.count += 1
        x = (self.count * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(low, [(room, bin_), self._priority(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (room, bin) with room >= size."""
        found, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, high = self._split(self.root, found)
            _, high = self._split(high, (found[0], found[1] + 1))
            self.root = self._merge(low, high)
        return found


class BestFit:
    """Best fit for sizes that come in falling order; bins are opened as needed."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.tree, self.bins = capacity, RoomTree(), 0

    def put(self, size: int) -> int:
        found = self.tree.take(size)
        if found is None:
            room, bin_ = max(self.capacity, size), self.bins
            self.bins += 1
        else:
            room, bin_ = found
        if room > size:
            self.tree.add(room - size, bin_)
        return bin_


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size, and how many bins it took. An item above the capacity has a bin of its own."""
    fit, out = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = fit.put(sizes[i])
    return out, fit.bins


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """At most `bins` bins of near equal size: best-fit decreasing at the smallest capacity that suffices."""
    out, order, left, alone = [0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sum(sizes), 0
    while order and bins - alone > 1 and sizes[order[0]] * (bins - alone) >= left:
        i = order.pop(0)
        out[i] = alone
        left -= sizes[i]
        alone += 1
    rest = [sizes[i] for i in order]
    if not rest:
        return out
    low = max(rest[0], -(-left // (bins - alone)))
    high, step = low, max(1, low // 4096)
    while best_fit_decreasing(rest, high)[1] > bins - alone:
        high += step
        step *= 2
    while low < high:
        mid = (low + high) // 2
        if best_fit_decreasing(rest, mid)[1] > bins - alone:
            low = mid + 1
        else:
            high = mid
    for i, b in zip(order, best_fit_decreasing(rest, high)[0], strict=True):
        out[i] = alone + b
    return out


def _packets(capacity: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, fit = None, None
        for frame in frames:
            at = []
            for b, size in zip(frame["bucket"].tolist(), frame["group_size"].tolist(), strict=True):
                if b != bucket:
                    bucket, fit = b, BestFit(capacity)
                at.append(fit.put(size))
            yield frame.assign(seq=at)[["group_key", "bucket", "seq", "group_size"]]

    return pack


def assign_shards(rows: DataFrame, shards: int = 16, grain: int = 256, rows_per_bucket: int = 1_000_000, most_buckets: int = 4096) -> DataFrame:
    """group_key -> shard, for rows with group_key (binary) and size (long)."""
    spark = rows.sparkSession
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    grain_bytes = max(1, total // (shards * grain))
    buckets = min(most_buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_bucket + 1))
    spread = groups.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(buckets)).cast("int")).withColumn("bucket", F.when(F.col("group_size") > grain_bytes, F.lit(-1)).otherwise(F.col("bucket")))
    small = (
        spread.filter("bucket >= 0")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", F.desc("group_size"), "group_key")
        .mapInPandas(_packets(grain_bytes), "group_key binary, bucket int, seq int, group_size long")
    )
    large = spread.filter("bucket < 0").select("group_key", "bucket", F.lit(0).alias("seq"), "group_size")
    packed = written(small.unionByName(large), "packets").withColumn("item_key", F.when(F.col("bucket") < 0, F.col("group_key")))
    most = 3 * shards * grain + most_buckets
    items = packed.groupBy("bucket", "seq", "item_key").agg(F.sum("group_size").alias("item_size")).limit(most + 1).collect()
    if len(items) > most:
        raise RuntimeError(f"{len(items)} items where at most {most} can be")
    items.sort(key=lambda r: (-r.item_size, r.bucket, r.seq, bytes(r.item_key or b"")))
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("item_key", T.BinaryType()), T.StructField("shard", T.IntegerType())])
    bins = pack_into([r.item_size for r in items], shards)
    placed = spark.createDataFrame([(r.bucket, r.seq, r.item_key, b) for r, b in zip(items, bins, strict=True)], schema).withColumnRenamed("bucket", "b").withColumnRenamed("seq", "s").withColumnRenamed("item_key", "k")
    on = (F.col("bucket") == F.col("b")) & (F.col("seq") == F.col("s")) & F.col("item_key").eqNullSafe(F.col("k"))
    return packed.join(F.broadcast(placed), on).select("group_key", "shard")  # at most `most` rows


def with_slots(rows: DataFrame, n_rows: int, shards: int, rows_per_part: int = 50_000, most_parts: int = 4096) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: rows are numbered in hashed parts of a shard, each part from the count
    of those before it, so no task holds a whole shard."""
    parts = max(1, min(most_parts, n_rows // (shards * rows_per_part) + 1) if n_rows else 1) * 4
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "group_key")
    return rows.withColumn("nth", F.row_number().over(within)).join(F.broadcast(counts), ["shard", "part"]).withColumn("slot", (F.col("offset") + F.col("nth") - 1).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", grain: int = 256) -> DataFrame:
    text = text_or_empty(text_col)
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group_key")), "sizes"
    )
    placed = written(rows.join(assign_shards(rows, shards, grain), "group_key"), "placed")
    out = with_slots(placed, placed.count(), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
