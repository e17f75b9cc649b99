"""Extraction and chunking over DataFrames: Arrow batches in Python where parsing is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import chunking, components, html, markdown
from ..functions import scalars as S

EXTRACT_SCHEMA = "url string, status string, reason string, title string, markdown string, description string, keywords array<string>, tags array<string>, links array<struct<url:string,anchor_text:string>>, weight double, published_at string, meta map<string,struct<kind:string,raw:string>>"
CHUNK_SCHEMA = "url string, ordinal int, section string, level int, path array<string>, text string"
SUMMARY = "__summary__"  # fixed value: the heading that stands for a page as a whole
MARKDOWN_SCHEMA = "url string, status string, reason string, title string, markdown string, description string, keywords array<string>, tags array<string>, weight double, published_ms long, meta map<string,string>"
COMPONENT_SCHEMA = "path string, markdown string, is_component boolean, description string, props array<struct<name:string,type:string,default:string>>"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", main: str = "main", drop: tuple[str, ...] = html.DROP_TAGS) -> DataFrame:
    """One row a page, whatever becomes of it: indexed, excluded or failed."""
    schema = _schema(EXTRACT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"url": u} | html.extract(u or "", h, main, drop) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([r | {"meta": list(r["meta"].items())} for r in rows], schema=schema)

    return pages.select(F.col(url_col), F.col(html_col)).mapInArrow(run, EXTRACT_SCHEMA)


def indexed(pages: DataFrame) -> DataFrame:
    """Of extracted pages those that are to be indexed; the others are as if there were none."""
    return pages.filter("status = 'indexed'")


def chunk_pages(pages: DataFrame, url_col: str = "url", markdown_col: str = "markdown", **options: int) -> DataFrame:
    """url, ordinal, section, level, path, text of each chunk."""
    schema = _schema(CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"url": u, "ordinal": i} | c for u, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(chunking.chunks(m or "", **options))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col(url_col).cast("string"), F.col(markdown_col)).mapInArrow(run, CHUNK_SCHEMA)


def index_chunks(pages: DataFrame, summary: bool = True, **options: int) -> DataFrame:
    """The chunks of pages as they are stored: url, ordinal, section, level, path, text, nth, chunk_key, content_hash,
    snippet, and the pages' other columns but their markdown and content_hash.

    With `summary` each page begins with a chunk that says what it is about. Keys tell chunks by what they say; equal ones
    of a page are counted. Hashes cover the text to embed, the metadata and whether the page is a custom one. pages: url,
    title, markdown, description, keywords, custom, meta.
    """
    kept = [f for f in pages.schema.fields if f.name not in ("url", "markdown", "content_hash", "snippet")]
    carried = pages.select(F.col("url").cast("string").alias("url"), F.col("markdown"), *[f.name for f in kept])
    raw = _schema(CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for i, (u, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = chunking.chunks(m or "", **options)
                if summary:
                    found = [{"section": None, "level": None, "path": [SUMMARY], "text": chunking.first_paragraph(m or "")}, *found]
                rows += [{"url": u, "ordinal": k} | c for k, c in enumerate(found)]
                of += [i] * len(found)
            own = pa.RecordBatch.from_pylist(rows, schema=raw)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*own.columns, *(batch.column(k).take(at) for k in range(2, batch.num_columns))], names=[*raw.names, *batch.schema.names[2:]])

    schema = StructType([*StructType.fromDDL(CHUNK_SCHEMA).fields, *kept])
    chunks = carried.mapInArrow(run, schema)
    about = F.col("path") == F.array(F.lit(SUMMARY))
    said = summary_text(F.col("title"), F.col("url"), F.col("description"), F.col("text"), F.col("keywords"))
    text = F.left(F.when(about, said).otherwise(F.col("text")), F.lit(S.CHUNK_TEXT_LENGTH))
    cleaned = F.transform("path", lambda h: F.lower(S.trim_blanks(h)))
    nth = F.row_number().over(Window.partitionBy("url", cleaned, F.sha1("text")).orderBy("ordinal")) - 1
    chunks = chunks.withColumn("about", about).withColumn("text", text).withColumn("nth", nth)
    key = S.chunk_key(F.col("url"), F.col("path"), F.when(F.col("about"), F.lit(SUMMARY)).otherwise(F.col("text")), F.col("nth"))
    meta = F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("meta")))), F.lit(""))
    origin = F.when(F.coalesce("custom", F.lit(False)), "custom").otherwise("site")
    digest = F.sha2(F.concat(S.normalize_text(S.embedding_text(F.col("title"), F.col("section"), F.col("text"))), meta, origin), 256)
    return chunks.withColumn("chunk_key", key).withColumn("content_hash", digest).withColumn("snippet", S.snippet(F.col("text"))).withColumn("path", F.when(F.col("about"), F.array().cast("array<string>")).otherwise(F.col("path"))).drop("about")


def summary_text(title: Column, url: Column, description: Column, lead: Column, keywords: Column) -> Column:
    """Title, readable path, description or first paragraph, keywords; empty parts are left out."""
    filled = lambda c: F.when(c != "", c)
    return F.concat_ws("\n\n", title, filled(S.humanize_url_path(url)), filled(F.coalesce(description, lead)), filled(F.array_join(keywords, ", ")))


def embedding_title(title: Column, section: Column, path: Column) -> Column:
    """Title, then the headings above the text, or its section where there are none."""
    return F.concat_ws(" > ", title, F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(F.when(section != "", section)))


def reassembled(chunks: DataFrame, key: str = "url", order: str = "ordinal", text: str = "text", title: Column | None = None) -> DataFrame:
    """key and markdown: the texts of a page's chunks in order, without the title that embedding put before them."""
    own = F.col(text)
    if title is not None:
        own = F.when(F.startswith(own, F.concat(title, F.lit("\n\n"))), F.substring(own, F.length(title) + 3, F.length(own))).otherwise(own)
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), own.alias("text"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("markdown"))


def extract_markdown(files: DataFrame, url_col: str = "url", markdown_col: str = "markdown", prefix: str = "search") -> DataFrame:
    """One row a markdown file, whatever becomes of it: indexed, excluded or failed."""
    schema = _schema(MARKDOWN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"url": u} | markdown.extract(u or "", m, prefix=prefix) for u, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([r | {"meta": list(r["meta"].items())} for r in rows], schema=schema)

    return files.select(S.normalize_url_path(F.col(url_col).cast("string")).alias("url"), F.col(markdown_col)).mapInArrow(run, MARKDOWN_SCHEMA)


def component_pages(files: DataFrame, path_col: str = "path", source_col: str = "source") -> DataFrame:
    """path, markdown, is_component, description, props of markup files; null source counts as empty."""
    schema = _schema(COMPONENT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, is_component = components.page_text(path or "", source)
                rows.append({"path": path, "markdown": text, "is_component": is_component} | (components.describe(source) if is_component else {"description": None, "props": []}))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(path_col, source_col).mapInArrow(run, COMPONENT_SCHEMA)


def with_excerpts(rows: DataFrame, text_col: str, query_col: str, out: str = "excerpt", length: int = S.SNIPPET_LENGTH) -> DataFrame:
    """Adds the excerpt of markdown text around each row's query; null text or query counts as empty."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([chunking.excerpt(t or "", q or "", length) for t, q in zip(texts, queries, strict=True)], dtype=object)

    return rows.withColumn(out, cut(S.markdown_to_plain(F.col(text_col)), F.col(query_col)))


def custom_pages(records: DataFrame) -> DataFrame:
    """Records (url, title, content, tags, weight) as pages: url, title, markdown, tags, weight, custom. The first
    segment of the url is a tag too. A record without content gives no page and is not a wish to delete one: callers
    count those as warnings with `empty_records`."""
    url = S.normalize_url_path(F.col("url"))
    tags = F.array_distinct(F.concat(F.slice(S.segments(url), 1, 1), F.coalesce("tags", F.array().cast("array<string>"))))
    pages = records.select(url.alias("url"), "title", S.normalize_markdown(F.coalesce("content", F.lit(""))).alias("markdown"), tags.alias("tags"), F.col("weight").cast("double").alias("weight"), F.lit(True).alias("custom"))
    return pages.filter(S.trim_blanks(F.col("markdown")) != "")


def empty_records(records: DataFrame) -> DataFrame:
    return records.filter(S.trim_blanks(F.coalesce("content", F.lit(""))) == "").select(S.normalize_url_path(F.col("url")).alias("url"))
