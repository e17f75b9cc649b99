"""Search: scored candidates, filters, boosts, trims, sections and the shape of results; related pages.

Scores come in as rows (qid, url, score) of any retrieval; a bounded set of queries (qid, query) says what was asked.
Filters run before the candidates are cut, so a filtered search never loses a page to one that the filter drops.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import pages as P
from . import ranking as R

KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
INTERNAL = ("route_file", "chunk_text", "breakdown")


class InvalidRequest(ValueError):
    """A request that cannot be answered as it stands."""


@dataclass(frozen=True)
class Request:
    """top_k from 1 to 100 and sub_results up to 20; what lies beyond is an error. by: page or chunk."""

    top_k: int = 10
    sub_results: int = 5
    path_prefix: str | None = None
    tags: tuple[str, ...] = ()
    filters: Mapping[str, str | float | bool] = field(default_factory=dict)
    by: str = "page"

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 100 or not 1 <= self.sub_results <= 20 or self.by not in ("page", "chunk"):
            raise InvalidRequest(f"top_k {self.top_k}, sub_results {self.sub_results}, by {self.by}")

    def candidates(self) -> int:
        return max(50, self.top_k) if self.by == "chunk" else max(2 * self.top_k, 20)


def overridden(boosts: R.Boosts, overrides: Mapping[str, float | bool], debug: bool) -> R.Boosts:
    """Boosts with some of them replaced, for debugging alone; names that are none raise."""
    unknown = set(overrides) - {f.name for f in fields(R.Boosts)}
    if unknown:
        raise InvalidRequest(f"no such ranking option: {sorted(unknown)}")
    return replace(boosts, **overrides) if debug else boosts


def below(url: Column, prefix: str) -> Column:
    """Plain prefix of the path; a missing leading slash is added. /doc is a prefix of /docs."""
    return F.startswith(url, F.lit(prefix if prefix.startswith("/") else f"/{prefix}"))


def has_tags(tags: Column, wanted: tuple[str, ...] | list[str]) -> Column:
    """Whether all wanted tags are among the tags; null tags are none."""
    asked = F.array(*map(F.lit, wanted)).cast("array<string>")
    return F.size(F.array_except(asked, F.coalesce(tags, F.array().cast("array<string>")))) == 0


def meta_matches(meta: Column, filters: Mapping[str, str | float | bool]) -> Column:
    """Typed filters over map<string, struct(kind, s, d, b, a)>: text is equal or among the values, numbers and truths are
    equal. Keys that are no names are left out; a quote or backslash in a value is an error."""
    out = F.lit(True)
    for key, wanted in filters.items():
        if not KEY.fullmatch(key):
            continue
        value = meta.getItem(key)
        if isinstance(wanted, str):
            if "'" in wanted or "\\" in wanted:
                raise InvalidRequest("filter values may not hold a quote or backslash")
            test = F.coalesce(value["s"] == wanted, F.lit(False)) | F.coalesce(F.array_contains(value["a"], wanted), F.lit(False))
        else:
            test = (value["b"] == wanted) if isinstance(wanted, bool) else (value["d"] == float(wanted))
        out = out & F.coalesce(test, F.lit(False))
    return out


def allowed_scope(asked: str | None, default: str, allowed: list[str]) -> str:
    """The default where none is asked for; a scope that is not listed is refused."""
    if asked is None or asked == default:
        return default
    if asked not in allowed:
        raise PermissionError(f"scope {asked} is not offered")
    return asked


def filtered(rows: DataFrame, request: Request) -> DataFrame:
    """rows with url, tags and, if the request filters by it, meta."""
    if request.path_prefix:
        rows = rows.filter(below(F.col("url"), request.path_prefix))
    if request.tags:
        rows = rows.filter(has_tags(F.col("tags"), request.tags))
    return rows.filter(meta_matches(F.col("meta"), request.filters)) if request.filters else rows


def ranked(scored: DataFrame, records: DataFrame, queries: DataFrame, request: Request = Request(), boosts: R.Boosts = R.Boosts(), weight: Column | None = None) -> DataFrame:
    """records of the best rows with qid, query, score, final_score and rank. scored: qid, key of the records (url, or
    chunk_key for chunks), score. weight: a Column over records that multiplies the boosted score of pages; 0 drops."""
    key = "chunk_key" if request.by == "chunk" else "url"
    hits = filtered(records, request).join(scored, key).join(F.broadcast(queries.select("qid", "query")), "qid")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    hits = hits.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= request.candidates()).drop("_nth")
    published = F.col("published_ms") if "published_ms" in records.columns else None
    anchor = F.col("anchor_text") if "anchor_text" in records.columns else None
    final = R.boosted(F.col("score"), F.col("incoming_links"), F.col("depth"), F.col("title"), F.col("query"), boosts, published, boosts_as_of(boosts), anchor)["final"]
    if weight is not None and request.by == "page":
        hits = hits.withColumn("_w", weight).filter("_w <> 0")
        final = final * F.col("_w")
    kept = R.trim(hits.withColumn("final_score", final).drop("_w"), boosts, gap=request.by == "page")
    best = Window.partitionBy("qid").orderBy(F.desc("final_score"), key)
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= request.top_k)


def boosts_as_of(boosts: R.Boosts) -> int:
    """Now, where freshness counts."""
    import time

    return int(time.time() * 1000) if boosts.use_freshness else 0


def results(pages: DataFrame, scored_chunks: DataFrame, chunks: DataFrame, request: Request = Request(), expanded: int = 10) -> DataFrame:
    """qid, rank, url, title, section_title, snippet, score, chunks of ranked pages. scored_chunks: qid, chunk_key, score;
    chunks: chunk_key, url, section, path, text, tags. Only the first `expanded` pages of a query show sections; pages
    are few, so they are broadcast. A page without sections is described by its description, else its title."""
    near = pages.filter(F.col("rank") <= expanded).select("qid", "url")
    found = chunks.join(scored_chunks, "chunk_key").join(F.broadcast(near), ["qid", "url"])
    nth = F.row_number().over(Window.partitionBy("qid", "url").orderBy(F.desc("score"), "chunk_key"))
    found = found.withColumn("nth", nth).filter(F.col("nth") <= request.sub_results)
    if request.tags:  # as for pages: sections are filtered after they are cut
        found = found.filter(has_tags(F.col("tags"), request.tags))
    found = P.with_excerpts(found.join(F.broadcast(pages.select("qid", "query").distinct()), "qid"), "text", "query", "snippet")
    own = found.groupBy("qid", "url").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("section").alias("section_title"), "snippet", F.col("text").alias("chunk_text"), F.col("path").alias("heading_path"), F.round("score", 6).alias("score")))).alias("chunks"))
    best = F.get("chunks", F.lit(0))
    told = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.col("title"))
    shown = F.transform("chunks", lambda c: c.dropFields("nth"))
    return pages.join(F.broadcast(own), ["qid", "url"], "left").select("qid", "rank", "url", "title", best["section_title"].alias("section_title"), F.coalesce(best["snippet"], told).alias("snippet"), best["chunk_text"].alias("chunk_text"), F.round("final_score", 6).alias("score"), *[c for c in ("route_file",) if c in pages.columns], shown.alias("chunks"))


def chunk_snippet(rows: DataFrame, out: str = "shown") -> DataFrame:
    """Adds what a chunk result shows: the excerpt around the query, else a stored snippet of 30 characters or more, else
    the text's own beginning. rows: query, text, snippet."""
    rows = P.with_excerpts(rows, "text", "query", "_excerpt")
    asked = (F.coalesce("query", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != "")
    stored = F.when(F.length("snippet") >= 30, F.col("snippet"))
    own = F.when(F.coalesce("text", F.lit("")) != "", S.snippet(F.col("text")))
    return rows.withColumn(out, F.coalesce(F.when(asked, F.col("_excerpt")), stored, own, F.col("snippet"), F.lit(""))).drop("_excerpt")


def public(rows: DataFrame) -> DataFrame:
    """Results without what only the site's owner should see, in nested sections too."""
    rows = rows.drop(*INTERNAL)
    if "chunks" in rows.columns and "chunk_text" in rows.schema["chunks"].dataType.elementType.names:
        rows = rows.withColumn("chunks", F.transform("chunks", lambda c: c.dropFields("chunk_text")))
    return rows


def composite(linked: Column, dice: Column, semantic: Column) -> Column:
    return 0.5 * linked.cast("int") + 0.3 * dice + 0.2 * semantic


def relationship(outgoing: Column, incoming: Column, dice: Column) -> Column:
    return F.when(outgoing, "outgoing").when(incoming, "incoming").when(dice > 0.4, "sibling").otherwise("semantic")


def related_pages(url: str, pages: DataFrame, edges: DataFrame, vectors: DataFrame, k: int = 10, near: int = 50) -> DataFrame:
    """url, title, score, kind of the pages most related to one page, by links, path and meaning. Candidates are its
    `near` nearest by vector and the pages it links to; that a candidate links back is then seen too. pages: url, title;
    edges: src_url, dst_url; vectors: url, v. A page that does not exist has no related ones."""
    source = vectors.filter(F.col("url") == url).limit(1).select(F.col("v").alias("q"))  # one row
    others = vectors.filter(F.col("url") != url).join(F.broadcast(source)).select("url", S.cosine(F.col("v"), F.col("q")).alias("semantic"))
    nearest = others.orderBy(F.desc("semantic"), "url").limit(near)
    out = edges.filter((F.col("src_url") == url) & (F.col("dst_url") != url)).select(F.col("dst_url").alias("url")).distinct().withColumn("outgoing", F.lit(True))
    back = edges.filter((F.col("dst_url") == url) & (F.col("src_url") != url)).select(F.col("src_url").alias("url")).distinct().withColumn("incoming", F.lit(True))
    found = nearest.join(out, "url", "full_outer").join(pages.select("url", "title"), "url").join(back, "url", "left")
    found = found.withColumn("outgoing", F.coalesce("outgoing", F.lit(False))).withColumn("incoming", F.coalesce("incoming", F.lit(False)))
    dice = S.dice_path(F.lit(url), F.col("url"))
    score = F.round(composite(F.col("outgoing") | F.col("incoming"), dice, F.coalesce("semantic", F.lit(0.0))), 6)
    return found.select("url", "title", score.alias("score"), relationship(F.col("outgoing"), F.col("incoming"), dice).alias("kind")).orderBy(F.desc("score"), "url").limit(min(k, 25))
