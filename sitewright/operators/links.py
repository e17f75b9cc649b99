"""Link graph: counts, anchors, reach, site tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ANCHOR_LENGTH = 500
STRUCTURE_PAGES = 2000  # fixed value: pages that one report shows


def known_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to pages that exist."""
    return links.join(pages.select(F.col("url").alias("dst_url")).distinct(), "dst_url", "left_semi")


def incoming_links(links: DataFrame) -> DataFrame:
    """How many distinct pages link to each url; a page's link to itself counts."""
    return links.groupBy(F.col("dst_url").alias("url")).agg(F.count_distinct("src_url").alias("incoming_links"))


def with_incoming(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.join(incoming_links(known_links(links, pages)), "url", "left").withColumn("incoming_links", F.coalesce("incoming_links", F.lit(0)))


def anchor_rollup(links: DataFrame, length: int = ANCHOR_LENGTH) -> DataFrame:
    """Distinct anchors of each target in source order, joined by blanks. The first that would not fit ends the list.

    Anchors are deduplicated before they are gathered, and as each has a letter and a blank at least, only the first
    `length` of a target can ever fit: that many are gathered, so a target that all pages link to stays bounded.
    """
    named = links.withColumn("anchor", S.normalize_anchor(F.col("anchor_text"))).filter("anchor <> ''")
    one = named.groupBy("src_url", "dst_url").agg(F.min_by("anchor", "pos").alias("anchor"))
    distinct = one.groupBy("dst_url", "anchor").agg(F.min("src_url").alias("src_url"))
    nth = F.row_number().over(Window.partitionBy("dst_url").orderBy("src_url", "anchor"))
    listed = distinct.withColumn("nth", nth).filter(F.col("nth") <= length).groupBy("dst_url").agg(F.array_sort(F.collect_list(F.struct("nth", "anchor"))).alias("all"))
    start = F.struct(F.lit(True).alias("go"), F.lit("").alias("t"))
    grown = lambda s, a: F.when(s["t"] == "", a["anchor"]).otherwise(F.concat(s["t"], F.lit(" "), a["anchor"]))
    step = lambda s, a: F.when(s["go"] & (F.length(grown(s, a)) <= length), F.struct(F.lit(True).alias("go"), grown(s, a).alias("t"))).otherwise(F.struct(F.lit(False).alias("go"), s["t"].alias("t")))
    return listed.select(F.col("dst_url").alias("url"), F.aggregate("all", start, step, lambda s: s["t"]).alias("anchor_text"))


def reach(links: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """url and least depth of all that can be reached from seeds (url), wave by wave over a shrinking frontier."""
    checkpoints = links.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()  # spark.checkpoint.dir sets it
    edges = links.select(F.col("src_url").alias("url"), "dst_url").distinct()
    edges = edges.checkpoint() if checkpoints else edges
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct()
    frontier, parts = seen, seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, "url").select(F.col("dst_url").alias("url")).distinct()
        frontier = found.join(parts.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        if checkpoints:
            frontier = frontier.checkpoint()
        if frontier.isEmpty():
            break
        parts = parts.unionByName(frontier)
    return parts


def site_tree(pages: DataFrame) -> DataFrame:
    """url, parent_url, depth, title, is_indexed, child_count of every page and every implied ancestor."""
    parts = S.segments(S.normalize_url_path(F.col("url")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    own = F.when(F.col("at") == S.normalize_url_path(F.col("url")), F.col("title"))
    nodes = pages.select("url", "title", F.explode(prefixes).alias("at")).groupBy("at").agg(F.max(own).alias("title"), F.max(F.when(F.col("at") == S.normalize_url_path(F.col("url")), 1).otherwise(0)).alias("indexed"))
    nodes = nodes.select(F.col("at").alias("url"), F.when(F.col("at") != "/", F.regexp_replace(F.regexp_replace("at", "/[^/]*$", ""), "^$", "/")).alias("parent_url"), S.url_depth(F.col("at")).alias("depth"), F.coalesce("title", F.lit("")).alias("title"), (F.col("indexed") == 1).alias("is_indexed"))
    counts = nodes.filter("parent_url IS NOT NULL").groupBy(F.col("parent_url").alias("url")).agg(F.count("*").alias("child_count"))
    return nodes.join(counts, "url", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def subtree(tree: DataFrame, prefix: str) -> DataFrame:
    """The part of a site tree at and below a path; a path that the tree lacks is an empty node of its own."""
    path = "/" + "/".join(x for x in prefix.split("/") if x)
    below = tree if path == "/" else tree.filter((F.col("url") == path) | F.startswith("url", F.lit(path + "/")))
    if not below.filter(F.col("url") == path).isEmpty():
        return below
    depth = path.count("/") if path != "/" else 0
    parent = None if path == "/" else path.rsplit("/", 1)[0] or "/"
    own = tree.sparkSession.createDataFrame([(path, parent, depth, "", False, 0)], "url string, parent_url string, depth int, title string, is_indexed boolean, child_count long")
    return below.unionByName(own)


def site_structure(pages: DataFrame, prefix: str = "/", most: int = STRUCTURE_PAGES) -> tuple[DataFrame, bool]:
    """The tree of the first `most` pages by url, or of its part below a path, and whether pages were left out."""
    first = pages.select("url", "title").orderBy("url").limit(most + 1)  # a report of bounded size
    return subtree(site_tree(first.orderBy("url").limit(most)), prefix), first.count() > most
