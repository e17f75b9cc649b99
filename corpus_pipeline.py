"""From raw documents to token ids: the corpus operators in a row.

Documents may be long and the stages share executors, so all of them take small batches.

Each stage reads what its predecessor wrote, judges all of it and returns the columns of documents; the last returns
each document's tokens. Rejected by the quality classifier, equal to an earlier text, near duplicate of another, or
holding a benchmark item: such documents are gone after the stage that says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewright.llm import bpe, decontaminate, exact_dedup, neardup, quality
from sitewright.llm.common import bounded_batches, table, written
from sitewright.llm.registry import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return neardup.drop_near_duplicates(docs, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), similarity=0.8)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.round_trip_digests(docs, tokenizer_path(), run_chars=1 << 20, remembered=50_000, keep_codec=False)  # little memory: earlier stages have grown the executors


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: The classifier and the consistent samples have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
