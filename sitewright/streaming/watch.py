"""Watching a folder of new pages, and a rate limit for each client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.index import Index


def watch(spark: SparkSession, folder: str, schema: str, act: Callable[[DataFrame], None], checkpoint: str, once: bool = True, every: str = "350 milliseconds") -> StreamingQuery:
    """Calls act with each batch of new files, one batch at a time; what comes meanwhile is the next batch."""
    stream = spark.readStream.schema(schema).parquet(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: act(batch))
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=every)).start()


def watch_into(index: Index, folder: str, checkpoint: str, once: bool = True, **run: object) -> StreamingQuery:
    """Indexes each batch of new page files (url, html) of a folder. A batch is a part of the site, so it deletes nothing;
    what is already stored is told by the index itself, and a batch that comes twice changes nothing."""
    return watch(index.spark, folder, "url string, html string", lambda batch: index.run(batch, warnings=("source-limited",), **run), checkpoint, once)


def rate_limit(events: DataFrame, key: str, ts_ms: str, most: int = 60, window_ms: int = 60_000) -> DataFrame:
    """Adds allowed: each key's window opens with its first event and is followed by the next after its end.

    Windows depend on all earlier events of the key, so a key's events are read in order of time by one task, which
    holds no more of them than when the window opened and how many it had. Null keys are a key; null times come first
    and open no window: they are refused.
    """
    rows = events.select(F.col(key), F.col(ts_ms).cast("long").alias(ts_ms))
    schema = StructType([*rows.schema.fields, StructField("allowed", BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, n = object(), None, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    now, opened = k, None
                if t is not None and (opened is None or t >= opened + window_ms):
                    opened, n = t, 0
                n += t is not None
                allowed.append(t is not None and n <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=[key, ts_ms, "allowed"])

    return rows.repartition(key).sortWithinPartitions(key, ts_ms).mapInArrow(judge, schema)


def session_counts(events: DataFrame, key: str, ts: str, gap_ms: int = 1_800_000) -> DataFrame:
    """An extension for event tables: how many sessions each key has, a session ending after a pause."""
    t = F.unix_millis(F.col(ts).cast("timestamp"))
    before = F.lag(t).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    return events.withColumn("new", F.when(before.isNull() | (t - before > gap_ms), 1).otherwise(0)).groupBy(key).agg(F.sum("new").alias("sessions"), F.count("*").alias("events"))
