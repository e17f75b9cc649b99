"""Tables as the queries see them, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url (normalised path), title, html of each page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", S.resolve_path(F.col("url")).alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html")


PATH_SQL = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
#: The SQL twin of normalize_url_path over an expression {x} without blanks at its ends.
NORMAL = "regexp_replace(regexp_replace(CASE WHEN {x} LIKE '/%' THEN {x} ELSE '/' || {x} END, '/+', '/', 'g'), '(.)/$', '\\1')"
PAGES_SQL = f"SELECT page_id, {NORMAL.format(x=PATH_SQL)} AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html FROM pages"
DEPTH_SQL = "len(list_filter(string_split(url, '/'), lambda s: s <> ''))"
