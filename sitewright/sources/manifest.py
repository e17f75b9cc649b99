"""Routes of a site's build manifest, and the pages that dynamic routes stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S

ROUTE_BLOCK = r'id:\s*"([^"]+)"((?:(?!id:\s*")[\s\S])*)'
PARAMETER = r"\[\[?[^\]]+\]\]?"


def route_url(route_id: Column) -> Column:
    """Groups in parentheses are no part of a URL."""
    kept = F.filter(F.split(route_id, "/"), lambda s: ~s.rlike(r"^\(.*\)$"))
    return F.when(F.array_join(kept, "/") == "", F.lit("/")).otherwise(F.array_join(kept, "/"))


def manifest_routes(manifests: DataFrame, text_col: str = "manifest") -> DataFrame:
    """route_id, url, route_file, is_dynamic of every page route in manifest texts."""
    ids, blocks = (F.regexp_extract_all(text_col, F.lit(ROUTE_BLOCK), F.lit(k)) for k in (1, 2))
    rows = manifests.select(F.explode(F.arrays_zip(ids.alias("id"), blocks.alias("block"))).alias("r")).filter(F.col("r.block").rlike(r"page:\s*\{"))
    route = F.col("r.id")
    file = F.when(route == "/", F.lit("src/routes/+page.svelte")).otherwise(F.concat(F.lit("src/routes"), route, F.lit("/+page.svelte")))
    return rows.select(route.alias("route_id"), route_url(route).alias("url"), file.alias("route_file"), F.contains(route, F.lit("[")).alias("is_dynamic"))


def expand_routes(routes: DataFrame, values: dict[str, list[str]], exclude: list[str] | None = None) -> DataFrame:
    """url, route_file: static routes, and one row a value for dynamic ones. values has lists by route id or by URL; a
    dynamic route without values gives no page. Values are settings, few by nature, so they stand in the plan."""
    known = F.lit(None).cast("array<string>")
    for key, listed in values.items():
        listed_column = F.array(*map(F.lit, listed)) if listed else F.lit(None).cast("array<string>")
        known = F.when(F.col("route_id") == key, listed_column).when(known.isNull() & (F.col("url") == key), listed_column).otherwise(known)
    rows = routes.filter(~P.matches_any(F.col("url"), exclude or []))
    rows = rows.withColumn("value", F.explode(F.when(F.col("is_dynamic"), known).otherwise(F.array(F.lit("")))))
    url = F.when(F.col("is_dynamic"), F.regexp_replace(F.col("url"), F.lit(PARAMETER), F.regexp_replace("value", r"([\\$])", r"\\$1"))).otherwise(F.col("url"))
    return rows.select(url.alias("url"), "route_file").filter(~P.matches_any(F.col("url"), exclude or []))


def route_lookup(pages: DataFrame, known: DataFrame, files: list[str]) -> DataFrame:
    """Adds route_file and resolution: what the source says of a page (known: url, route_file; one row a url), else
    the most specific route pattern."""
    said = known.select(S.normalize_url_path(F.col("url")).alias("_u"), F.col("route_file").alias("_f"))
    joined = pages.withColumn("_u", S.normalize_url_path(F.col("url"))).join(said, "_u", "left").withColumn("_r", P.route_for(F.col("_u"), files))
    resolution = F.when(F.col("_f").isNotNull(), F.lit("exact")).otherwise(F.col("_r.resolution"))
    return joined.withColumn("route_file", F.coalesce("_f", "_r.route_file")).withColumn("resolution", resolution).drop("_u", "_f", "_r")
