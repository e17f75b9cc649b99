"""Boosts, trims and measures of ranked results. Rows of several queries are told apart by `qid`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import scalars as S


@dataclass(frozen=True)
class Boosts:
    incoming_links: float = 0.05
    depth: float = 0.03
    title_match: float = 0.15
    freshness: float = 0.1
    anchor_text: float = 0.1
    decay: float = 0.001
    min_score_ratio: float = 0.7
    score_gap: float = 0.4
    use_freshness: bool = False
    use_anchor: bool = False


def boosted(score: Column, links: Column, depth: Column, title: Column, query: Column, b: Boosts = Boosts(), published_ms: Column | None = None, as_of_ms: int = 0, anchor: Column | None = None) -> dict[str, Column]:
    """The parts of a score: base, each boost, and their sum `final`."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    parts = {
        "base": F.when(bad, F.lit(float("-inf"))).otherwise(score),
        "link_boost": F.log1p(S.non_negative_or_zero(links.cast("double"))) * b.incoming_links,
        "depth_boost": b.depth / (1 + S.non_negative_or_zero(depth.cast("double"))),
        "title_boost": F.when(S.matches_either_way(query, title), b.title_match).otherwise(0.0),
    }
    if b.use_freshness and published_ms is not None:
        days = F.greatest(F.lit(0.0), (as_of_ms - published_ms) / 86_400_000.0)
        parts["freshness_boost"] = F.coalesce(b.freshness / (1 + days * b.decay), F.lit(0.0))
    if b.use_anchor and anchor is not None:
        parts["anchor_boost"] = F.when(S.matches_either_way(query, anchor), b.anchor_text).otherwise(0.0)
    total = sum(parts.values(), F.lit(0.0))
    parts["final"] = F.when(F.isnan(total) | (F.abs(total) == float("inf")), F.lit(float("-inf"))).otherwise(total)
    return parts


def rank_pages(hits: DataFrame, k: int, b: Boosts = Boosts(), weight: Column | None = None) -> DataFrame:
    """Best k pages of hits (score, incoming_links, depth, title, query, url); a weight multiplies the boosted score."""
    parts = boosted(F.col("score"), F.col("incoming_links"), F.col("depth"), F.col("title"), F.col("query"), b)
    ranked = hits.withColumn("final_score", parts["final"])
    if weight is not None:
        ranked = ranked.withColumn("_w", weight).filter("_w <> 0").withColumn("final_score", F.col("final_score") * F.col("_w")).drop("_w")
    return ranked.orderBy(F.desc("final_score"), "url").limit(k)


def trim(ranked: DataFrame, b: Boosts = Boosts(), keys: tuple[str, ...] = ("qid",), gap: bool = True) -> DataFrame:
    """Drops rows far below the top; with gap, also all from the first large drop between neighbours on."""
    top = F.max("final_score").over(Window.partitionBy(*keys))
    kept = ranked.withColumn("_top", top).filter((F.col("_top") <= 0) | (F.col("final_score") >= F.col("_top") * b.min_score_ratio)).drop("_top")
    if not gap:
        return kept
    order = Window.partitionBy(*keys).orderBy(F.desc("final_score"), "url")
    before = F.lag("final_score").over(order)
    broken = F.coalesce((before > 0) & ((before - F.col("final_score")) / before >= b.score_gap), F.lit(False)).cast("int")
    so_far = F.max("_broken").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.withColumn("_broken", broken).withColumn("_cut", so_far).filter("_cut = 0").drop("_broken", "_cut")


def measures(ranked: DataFrame, k: int) -> DataFrame:
    """qid, reciprocal_rank, precision, ndcg of ranked rows (qid, rank from 1, relevance)."""
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1.0)
    ideal = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "rank"))
    best = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("ideal") + 1.0)
    rows = ranked.withColumn("ideal", ideal)
    out = rows.groupBy("qid").agg(
        F.coalesce(1.0 / F.min(F.when(F.col("relevance") > 0, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        (F.sum(F.when((F.col("rank") <= k) & (F.col("relevance") > 0), 1).otherwise(0)) / k).alias("precision"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, best).otherwise(0.0)).alias("idcg"),
    )
    return out.select("qid", "reciprocal_rank", "precision", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def assertions(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """qid, kind and passed, a row for each thing that is expected of a query's results. ranked: qid, url, rank from 1;
    expected: qid, top_result, in_top_5 (an array) and max_results, each null where nothing is expected."""
    first = F.max(F.when(F.col("rank") == 1, F.col("url"))).alias("top")
    seen = ranked.groupBy("qid").agg(first, F.collect_set(F.when(F.col("rank") <= 5, F.col("url"))).alias("best"), F.count("*").alias("n"))
    both = expected.join(seen, "qid", "left").withColumn("best", F.coalesce("best", F.array().cast(ArrayType(ranked.schema["url"].dataType))))
    tests = F.array(
        F.when(F.col("top_result").isNotNull(), F.struct(F.lit("top_result").alias("kind"), F.coalesce(F.col("top") == F.col("top_result"), F.lit(False)).alias("passed"))),
        F.when(F.col("in_top_5").isNotNull(), F.struct(F.lit("in_top_5").alias("kind"), (F.size(F.array_except("in_top_5", "best")) == 0).alias("passed"))),
        F.when(F.col("max_results").isNotNull(), F.struct(F.lit("max_results").alias("kind"), (F.coalesce("n", F.lit(0)) <= F.col("max_results")).alias("passed"))),
    )
    return both.select("qid", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("t")).select("qid", "t.kind", "t.passed")


def with_sections(ranked: DataFrame, sections: DataFrame, key: str, score: str, tie: str, expanded: int = 10, most: int = 5) -> DataFrame:
    """Adds best sections to ranked rows (key, rank): the first `most` of each of the `expanded` best rows, by score;
    rows further down, and rows without sections, have one row with null in the columns of sections. The expanded keys
    are a bounded report, so sections of all others go before any shuffle of them."""
    best = ranked.filter(F.col("rank") <= expanded).select(key).orderBy("rank").limit(expanded)
    near = sections.join(F.broadcast(best), key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    near = near.withColumn("section_rank", F.row_number().over(order)).filter(F.col("section_rank") <= most)
    return ranked.join(near, key, "left")


def numbered(rows: DataFrame, key: Column, name: str = "nth", rows_per_part: int = 1000, most_parts: int = 512) -> DataFrame:
    """Adds a number from 1 in the order of key, which must tell all rows apart (ties are numbered in any order).

    Rows are numbered in ranges of the key, each from the count of those before it, so no task holds all rows. The
    bounds come from a hashed sample of some hundred keys a range, the same whenever it is drawn.
    """
    keyed = rows.withColumn("_key", key)
    n = keyed.count()
    parts = min(most_parts, n // rows_per_part + 1)
    each = max(1, n // (parts * 100))
    bounds = []
    if parts > 1:
        drawn = [r[0] for r in keyed.filter(F.pmod(F.xxhash64("_key"), F.lit(each)) == 0).select("_key").orderBy("_key").collect()]  # about 100 a range
        bounds = [drawn[len(drawn) * k // parts] for k in range(1, parts)] if drawn else []
    fields = keyed.schema["_key"].dataType
    literal = lambda b: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, fields.fields, strict=True)])
    part = F.size(F.filter(F.array(*map(literal, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    placed = keyed.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over at most most_parts rows
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return placed.withColumn("_nth", nth).join(F.broadcast(counts), "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_key", "_part", "_nth", "_before")
