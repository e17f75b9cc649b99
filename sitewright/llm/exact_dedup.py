"""Exact duplicates by a tree-merge of sorted digest runs.

Each input partition is one run: its rows, sorted by digest, with one entry a digest. Runs are merged in binomial
rounds: in round k, run r + 2 ** k goes to run r (r a multiple of 2 ** (k + 1)), so ceil(log2(runs)) rounds leave one
run. An entry is the row that stays so far and the number of rows behind it; merging two sorted runs keeps, of equal
digests, the better entry and the sum. Every run is dealt over all tasks by digest, so late rounds, with few runs, are
as parallel as early ones, and a digest that holds a third of all rows reaches any task as one entry a run, never as
its rows. Each round is written down: a lost executor costs the rest of its round.

Entries are merged only if both the SHA-256 of the normalised text and its length agree; the row that stays is chosen
by a total order (most code points, smallest id, row number), so every order of merging gives the same rows.

Defined results: a null text is the empty text; a null id sorts after all ids; rows that agree in everything keep
one of them; an empty table gives an empty result; other columns of any name are left alone. Whitespace here is
U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One light row for each document: its id, length, digest, run and a row number that is written down once."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.length(text).alias("n_points"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.octet_length(normalised(text)).alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
    )


def sorted_runs(rows: DataFrame) -> DataFrame:
    """run, digest, n_bytes, best (the entry that stays), size: one entry a digest and run."""
    entry = F.struct((-F.col("n_points")).alias("neg_points"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    return rows.select("run", "digest", "n_bytes", entry.alias("best"), F.lit(1).cast("long").alias("size"))


def merged(runs: DataFrame) -> DataFrame:
    """Entries of one run and digest become one. Grouping sorts by run and digest on both sides of the exchange, so what
    a task reads and writes are sorted runs, and merging them is one pass."""
    return runs.groupBy("run", "digest", "n_bytes").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def merge_runs(rows: DataFrame) -> DataFrame:
    """digest, n_bytes -> best and size, over all runs."""
    last = rows.agg(F.max("run")).first()[0]
    runs, step = sorted_runs(rows), 1
    while last is not None and step <= last:
        sent = F.col("run").bitwiseAND(F.lit(step)) != 0
        runs = written(merged(runs.withColumn("run", F.when(sent, F.col("run") - step).otherwise(F.col("run")))), f"runs-{step}")
        step *= 2
    return written(merged(runs), "groups").drop("run") if step == 1 else runs.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    groups = merge_runs(rows)  # written, so that the join's tasks can be split where a digest is hot
    return rows.join(groups, ["digest", "n_bytes"]).select(
        F.col("id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, all columns as they were. Rows move once: joining and
    telling apart rows that agree in everything go by one key."""
    best = merge_runs(written(digest_rows(docs, id_col, text_col), "digests"))
    best = best.select(row_key(F.col("digest"), F.col("best.id"), -F.col("best.neg_points")).alias("key"))
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(normalised(text), 256))
    keyed = docs.select(F.struct("*").alias("doc"), row_key(digest, F.col(id_col), F.length(text)).alias("key"))
    return keyed.join(best, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def row_key(digest: Column, row_id: Column, n_points: Column) -> Column:
    """Digest, length and id in one text that is never null; no id is told from every id."""
    return F.concat_ws(":", F.hex(digest), n_points, F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("-")))
