"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HOT = 50_000  # keys that may be broadcast as hot ones: a few MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that spark.checkpoint.dir names. Where that is unset, as in tests, a local
    session gets a temporary one; a cluster, whose machines would not share it, an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        path = context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(path)
        path = context._jsc.sc().getCheckpointDir().get()
    if not path:
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
    return f"{path.rstrip('/')}/{context.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut and lost executors cost no rework."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As written(), in as many buckets by key as there are shuffle partitions: joins by key leave it where it lies."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", fresh_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what written() wrote for df, when nothing that is still to run reads it."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if path.startswith(shared_dir(spark)) or f"/{spark.sparkContext.applicationId}/" in path:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; for when its results are written elsewhere."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def counted_twice(rows: DataFrame, counts: DataFrame, key: str, most_hot: int = MOST_HOT) -> DataFrame:
    """The rows whose key counts (key and n, one row a key) counted more than once. Keys of so many rows that there are at
    most `most_hot` of them are broadcast, so that their rows stay where they lie; the others are joined by a shuffle, in
    which no key has more rows."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_from = max(1000, total // most_hot)
    hot = F.broadcast(counts.filter(F.col("n") >= hot_from).select(key))
    rest = counts.filter((F.col("n") > 1) & (F.col("n") < hot_from)).select(key)
    return rows.join(hot, key, "left_semi").unionByName(rows.join(hot, key, "left_anti").join(rest, key, "left_semi"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """From now on this session hands Python at most that many rows and bytes at once, if it handed over more before."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(key, str(most))


def trimmed() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task. After the last one, free memory goes back to the system: workers outlive their tasks, and
    what an idle one holds is missing from its executor."""
    yield from batches
    trimmed()


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str, most: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each Arrow batch, in parts of at most `most` rows, with the named columns as Python lists: one part's texts are
    held at a time."""
    for batch in released(batches):
        for i in range(0, batch.num_rows, most):
            part = batch.slice(i, most)
            yield part, [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
