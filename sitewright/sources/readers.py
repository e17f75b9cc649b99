"""Sources: static HTML folders, content files, sitemaps; and the text sinks."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranking as R

PRERENDER_IGNORED = r"(^|/)(_app/|200\.html$|404\.html$|fallback\.html$|_worker\.js)"


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """relative path and text of the files below a folder whose names match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    root = re.sub("^[a-z]+:/+", "/", folder.rstrip("/")) + "/"
    path = plain(F.col("path"))
    below = F.position(F.lit(root), path) + len(root)  # the store may write a host before the folder
    return files.select(F.substring(path, below, F.length(path)).alias("relative"), F.col("content").cast("string").alias("text"))


def static_html(spark: SparkSession, folder: str, ignored: str | None = None, max_pages: int | None = None) -> DataFrame:
    """url, html of every .html file below a folder, by path."""
    rows = _files(spark, folder, "*.html")
    if ignored:
        rows = rows.filter(~F.col("relative").rlike(ignored))
    rows = rows.select(S.html_file_to_url(F.col("relative")).alias("url"), F.col("text").alias("html"))
    return rows if max_pages is None else rows.orderBy("url").limit(max(0, max_pages))


def content_files(spark: SparkSession, folder: str) -> DataFrame:
    """url, markdown of every .md file below a folder."""
    return _files(spark, folder, "*.md").select(S.content_file_to_url(F.col("relative")).alias("url"), F.col("text").alias("markdown"))


def limited(pages: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first `most` pages by url, and whether that left any out."""
    first = pages.orderBy("url").limit(max(0, most) + 1)  # a report of `most` rows
    return first.orderBy("url").limit(max(0, most)), first.count() > max(0, most)


def sitemap_tree(fetch: Callable[[list[str]], DataFrame], roots: list[str], most: int = 50) -> tuple[DataFrame, list[str]]:
    """Paths named by sitemaps and by those that sitemap indexes lead to, and warnings. fetch gives url and content
    (binary, perhaps gzipped; null where it failed) of some addresses. At most `most` sitemaps are read in a run."""
    waiting, seen, warnings, found = list(dict.fromkeys(roots)), set(), [], None
    while waiting and len(seen) < most:
        now = waiting[: most - len(seen)]
        waiting = waiting[len(now) :]
        seen.update(now)
        xml = sitemap_texts(fetch(now))
        broken = [r.url for r in xml.filter("xml IS NULL").select("url").collect()]  # at most `most`
        warnings += [f"unreadable sitemap: {u}" for u in broken]
        xml = xml.filter("xml IS NOT NULL").withColumn("is_index", F.col("xml").rlike(r"<(\w+:)?sitemapindex[\s>]"))
        nested = xml.filter("is_index").select(F.explode(F.xpath("xml", F.lit("//*[local-name()='loc']/text()"))).alias("loc")).distinct()
        more = [r["loc"].strip() for r in nested.orderBy("loc").limit(most + 1).collect()]  # no more can be read anyway
        waiting += [u for u in more if u not in seen and u not in waiting]
        urls = sitemap_urls(xml.filter("NOT is_index"))
        found = urls if found is None else found.unionByName(urls)
    if waiting:
        warnings.append("sitemap limit reached")
    return found.distinct(), warnings


def sitemap_texts(files: DataFrame) -> DataFrame:
    """url and xml of sitemaps (url, content), unpacked where they are gzipped; null where that fails."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append((gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8", "replace") if data else None)
                except (OSError, EOFError, zlib.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["url", "xml"])

    return files.select(F.col("url").cast("string").alias("url"), F.col("content").cast("binary").alias("content")).mapInArrow(unpack, "url string, xml string")


def sitemap_urls(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Distinct normalised paths of a table of sitemap texts."""
    locs = F.explode(F.xpath(F.col(xml_col), F.lit("//*[local-name()='loc']/text()"))).alias("loc")
    return sitemaps.select(locs).filter(F.col("loc").rlike("^https?://")).select(S.resolve_path(F.col("loc")).alias("url")).distinct()


LISTS = ("/llms.txt", "/llms-full.txt")  # fixed values: the lists do not list themselves


def _listed(pages: DataFrame) -> DataFrame:
    """The pages with their number in a list: least deep first, then most linked, then by url."""
    order = F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), (-F.coalesce("incoming_links", F.lit(0))).alias("links"), "url")
    return R.numbered(pages.filter(~F.col("url").isin(*LISTS)), order)


def llms_txt(pages: DataFrame, title: str, description: str = "", base_url: str = "") -> DataFrame:
    """nth and line of an llms.txt for a site's pages (url, title, description, depth, incoming_links)."""
    spark = pages.sparkSession
    head = [f"# {title}", ""] + ([f"> {description}", ""] if description else []) + ["## Pages", ""]
    link = S.join_url(F.lit(base_url), F.col("url")) if base_url else F.col("url")
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(F.lit(""))
    lines = _listed(pages).select((F.col("nth") + len(head)).alias("nth"), F.concat(F.lit("- ["), "title", F.lit("]("), link, F.lit(")"), told).alias("line"))
    return spark.createDataFrame(list(enumerate(head, 1)), "nth long, line string").unionByName(lines)


def llms_full(pages: DataFrame, title: str, description: str = "", base_url: str = "") -> DataFrame:
    """nth and line (a block of lines) of an llms-full.txt: each page's link as a heading, then its markdown."""
    spark = pages.sparkSession
    head = [f"# {title}", ""] + ([f"> {description}", ""] if description else [])
    link = S.join_url(F.lit(base_url), F.col("url")) if base_url else F.col("url")
    block = F.concat(F.lit("---\n\n## ["), "title", F.lit("]("), link, F.lit(")\n\n"), S.trim_blanks(F.coalesce("markdown", F.lit(""))), F.lit("\n"))
    lines = _listed(pages).select((F.col("nth") + len(head)).alias("nth"), block.alias("line"))
    return spark.createDataFrame(list(enumerate(head, 1)), "nth long, line string").unionByName(lines)


def write_lines(lines: DataFrame, folder: str) -> None:
    """Lines (nth, line) as text files whose names sort as the lines do; written by the executors."""
    lines.repartitionByRange("nth").sortWithinPartitions("nth").select("line").write.mode("overwrite").text(folder)
