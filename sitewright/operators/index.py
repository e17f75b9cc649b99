"""The page and chunk index: Parquet snapshots for each project and scope, swapped as a whole.

A run writes a new snapshot beside the old one, and when all of it is there, an empty file whose name holds the next
number and the snapshot's name. Readers take the highest number, so they see either all of a run or nothing of it, and a
run that dies leaves the index as it was. One writer a scope is expected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import scalars as S
from . import diff, links as L, pages as P


Change = Callable[[DataFrame], DataFrame]
KINDS = ("pages", "chunks")


@dataclass(frozen=True)
class Hooks:
    """What a user does to a run, as DataFrame functions: transform_page and transform_chunk drop or change rows (custom
    pages stay custom), before_index sees all chunks, after_index the stats once all is written; its error is raised and
    undoes nothing."""

    transform_page: Change = lambda pages: pages
    transform_chunk: Change = lambda chunks: chunks
    before_index: Change = lambda chunks: chunks
    after_index: Callable[[RunStats], None] = lambda stats: None


@dataclass(frozen=True)
class Rules:
    """What a site's owner says of its pages: patterns to leave out, robots rules, weights by pattern (0 leaves out), route
    files, and whether pages begin with a summary chunk (off unless asked for)."""

    exclude: tuple[str, ...] = ()
    robots: patterns.RobotsRules | None = None
    weights: Mapping[str, float] = field(default_factory=dict)
    routes: tuple[str, ...] = ()
    summary_chunks: bool = False


@dataclass
class RunStats:
    status: dict[str, int] = field(default_factory=dict)
    chunk_status: dict[str, int] = field(default_factory=dict)
    deleted: int = 0
    excluded: int = 0
    failed: int = 0
    gate: diff.Gate = diff.Gate(True, ())
    warnings: tuple[str, ...] = ()
    snapshot: str | None = None


class Index:
    """Reads and writes one scope."""

    def __init__(self, spark: SparkSession, root: str, project: str, scope: str) -> None:
        self.spark, self.base = spark, f"{root.rstrip('/')}/{project}/{scope}"
        self.project, self.scope = project, scope

    def _at(self, path: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}".rstrip("/"))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _commits(self) -> list[str]:
        fs, at = self._at("commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _current(self) -> str | None:
        commits = self._commits()
        return commits[-1].partition("-")[2] if commits else None

    def _commit(self, name: str) -> None:
        commits = self._commits()
        number = int(commits[-1].partition("-")[0]) + 1 if commits else 1
        fs, at = self._at(f"commits/{number:012d}-{name}")
        fs.create(at, False).close()

    def read(self, kind: str = "pages") -> DataFrame | None:
        name = self._current()
        return self.spark.read.parquet(f"{self.base}/{name}/{kind}") if name else None

    def health(self) -> tuple[bool, str | None]:
        """Whether the index can be read, and what it says if not; a scope without runs can."""
        try:
            found = self.read()
            if found is not None:
                found.limit(1).count()
        except Exception as e:  # whatever the store says is put in our own words
            return False, type(e).__name__
        return True, None

    def hashes(self, kind: str = "pages") -> DataFrame | None:
        """key, content_hash, custom of all records of a kind."""
        found = self.read(kind)
        key = "url" if kind == "pages" else "chunk_key"
        return None if found is None else inventory(found, key)

    def run(
        self, source: DataFrame, main: str = "main", warnings: tuple[str, ...] = (), max_ratio: float = 0.5, allow_empty: bool = False, accepted: bool = False,
        dry_run: bool = False, custom: DataFrame | None = None, hooks: Hooks = Hooks(), rules: Rules = Rules(),
    ) -> RunStats:
        """source: url, html. Stored rows that the source lacks are deleted only if the gate lets them be. custom: records
        (url, title, content, tags, weight); None says nothing of stored custom pages, so they stay, an empty table that
        there are none. Chunks of unknown pages are dropped. Pages that rules or robots leave out count as gone."""
        name, stats = f"snapshot-{uuid.uuid4().hex}", RunStats()
        found = P.extract_pages(source, main=main).withColumn("url", S.resolve_path(F.col("url")))
        found = self._written(self._ruled(found, rules), f"{name}/extracted")  # parsed and judged once
        counts = {r.status: r.n for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}
        stats.excluded, stats.failed = counts.get("excluded", 0), counts.get("failed", 0)
        pages = self._written(self._pages(found, custom, hooks, rules), f"{name}/found")
        stored = self.read()
        failed = found.filter("status = 'failed'").select("url")
        if stored is None:
            merged = pages
            stats.status = {"new": pages.count()}
        else:
            stats.status = self._statuses(pages, stored, "url")
            gone = diff.stale(stored, pages, "url")
            removed = diff.stale(stored, pages, "url", custom_records_given=custom is not None).join(failed, "url", "left_anti")
            n_stored, n_gone = stored.count(), removed.count()
            empty = custom is not None and not P.empty_records(custom).isEmpty()
            stats.warnings = warnings + (("failed-pages",) if empty or stats.failed else ())
            stats.gate = diff.deletion_gate(n_stored, n_gone, sum(counts.values()), stats.warnings, max_ratio, allow_empty, accepted)
            stats.deleted = n_gone if stats.gate.eligible else 0
            kept = gone.join(removed.select("url"), "url", "left_anti") if stats.gate.eligible else gone
            merged = pages.unionByName(kept, allowMissingColumns=True)
        if not dry_run:
            merged = self._written(merged, f"{name}/pages")
            chunks = hooks.before_index(hooks.transform_chunk(P.index_chunks(merged.drop("links", "summary"), rules.summary_chunks)))
            chunks = self._written(chunks.join(merged.select("url"), "url", "left_semi"), f"{name}/chunks")
            old = self.read("chunks")
            stats.chunk_status = {"new": chunks.count()} if old is None else self._statuses(chunks, old, "chunk_key")
            self._commit(name)
            stats.snapshot = name
        for part in ("extracted", "found") if not dry_run else ("",):
            fs, at = self._at(f"{name}/{part}")
            fs.delete(at, True)
        if not dry_run:
            hooks.after_index(stats)
        return stats

    @staticmethod
    def _ruled(found: DataFrame, rules: Rules) -> DataFrame:
        """Status and reason of pages after patterns, robots rules and weights."""
        weight = patterns.effective_weight(F.col("url"), F.col("weight"), dict(rules.weights))
        tests = [(patterns.matches_any(F.col("url"), list(rules.exclude)), "pattern"), (weight == 0, "weight")]
        if rules.robots is not None:
            tests.append((patterns.blocked_by_robots(F.col("url"), rules.robots), "robots"))
        why = F.coalesce(*[F.when((F.col("status") == "indexed") & test, F.lit(reason)) for test, reason in tests])
        return found.withColumn("_why", why).withColumn("status", F.when(F.col("_why").isNotNull(), "excluded").otherwise(F.col("status"))).withColumn("reason", F.coalesce("_why", "reason")).drop("_why")

    def _pages(self, found: DataFrame, custom: DataFrame | None, hooks: Hooks, rules: Rules) -> DataFrame:
        """The run's pages as they are stored: one a url, with links, anchors, route, hash and summary."""
        extracted = found.filter("status = 'indexed'").withColumn("custom", F.lit(False))
        if custom is not None:
            own = P.custom_pages(custom).withColumn("links", F.array().cast(found.schema["links"].dataType))
            extracted = extracted.unionByName(own, allowMissingColumns=True)
        pages = hooks.transform_page(extracted.withColumnRenamed("custom", "_custom")).withColumnRenamed("_custom", "custom")
        pages = diff.dedupe_first(pages, "url", "custom", "title")
        edges = pages.select(F.col("url").alias("src_url"), F.posexplode("links").alias("pos", "l")).select("src_url", "pos", F.col("l.url").alias("dst_url"), F.col("l.anchor_text").alias("anchor_text"))
        pages = L.with_incoming(pages, edges).join(L.anchor_rollup(L.known_links(edges, pages)), "url", "left")
        route = patterns.route_for(F.col("url"), list(rules.routes)) if rules.routes else F.struct(F.lit(None).cast("string").alias("route_file"), F.lit(None).cast("string").alias("resolution"))
        pages = pages.withColumn("_r", route).withColumn("route_file", F.col("_r.route_file")).withColumn("route_resolution", F.col("_r.resolution")).drop("_r")
        outgoing = F.transform("links", lambda x: x["url"])
        meta = F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("meta")))), F.lit("{}"))
        digest = S.page_hash(F.col("title"), F.col("description"), F.col("keywords"), F.col("tags"), F.col("markdown"), F.size("links"), F.col("published_at"), F.coalesce("anchor_text", F.lit("")), F.col("custom"), F.col("weight"), outgoing, meta)
        pages = pages.withColumn("content_hash", digest).withColumn("depth", S.url_depth(F.col("url"))).withColumn("outgoing", F.array_distinct(outgoing))
        pages = pages.withColumn("summary", S.page_summary(F.col("title"), F.col("description"), F.col("keywords"), F.col("markdown")))
        return pages.withColumn("schema_version", F.lit(S.SCHEMA_VERSION)).withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))

    def _statuses(self, current: DataFrame, stored: DataFrame, key: str) -> dict[str, int]:
        return {r.status: r.n for r in diff.classify(current, stored, key).groupBy("status").agg(F.count("*").alias("n")).collect()}

    def _written(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(f"{self.base}/{path}")
        return self.spark.read.parquet(f"{self.base}/{path}")

    def delete(self, urls: DataFrame) -> int:
        """Deletes pages (url) and their chunks from this scope alone; how many pages went."""
        pages, chunks = self.read(), self.read("chunks")
        if pages is None:
            return 0
        asked = urls.select(S.normalize_url_path(F.col("url")).alias("url")).distinct()
        n, name = pages.join(asked, "url", "left_semi").count(), f"snapshot-{uuid.uuid4().hex}"
        for kind, rows in zip(KINDS, (pages, chunks), strict=True):
            self._written(rows.join(asked, "url", "left_anti"), f"{name}/{kind}")
        self._commit(name)
        return n

    def drop(self) -> None:
        """Deletes the scope with all its snapshots."""
        fs, at = self._at()
        fs.delete(at, True)


def inventory(records: DataFrame, key: str, hash_col: str = "content_hash") -> DataFrame:
    """key, content_hash and custom (false where unknown) of stored records."""
    custom = F.coalesce("custom", F.lit(False)) if "custom" in records.columns else F.lit(False)
    return records.select(key, F.col(hash_col).alias("content_hash"), custom.alias("custom"))


def in_scope(records: DataFrame, project: str, scope: str) -> DataFrame:
    """The records of one scope of one project; a null name is no scope."""
    return records.filter((F.col("project_id") == project) & (F.col("scope_name") == scope))


def scope_inventory(records: DataFrame, project: str) -> DataFrame:
    """scope_name, documents, last_indexed_at of a project's records (project_id, scope_name, indexed_at); times that
    cannot be read are left out, and a scope without any is `unknown`."""
    last = F.max(F.try_to_timestamp("indexed_at"))
    return records.filter(F.col("project_id") == project).groupBy("scope_name").agg(F.count("*").alias("documents"), F.coalesce(F.date_format(last, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown")).alias("last_indexed_at"))


def is_legacy(version: Column | None = None, current: int = S.SCHEMA_VERSION):
    version = F.col("schema_version") if version is None else version
    return version.isNull() | (version < current)


def legacy_counts(records: DataFrame, project: str, current: int = S.SCHEMA_VERSION) -> DataFrame:
    """kind and n of a project's records (project_id, kind, schema_version) of an older layout or none."""
    return records.filter(F.col("project_id") == project).filter(is_legacy(current=current)).groupBy("kind").agg(F.count("*").alias("n"))


def without_legacy(records: DataFrame, project: str, current: int = S.SCHEMA_VERSION) -> DataFrame:
    """All records but the project's legacy ones, judged as they are now."""
    return records.filter(~(F.coalesce(F.col("project_id") == project, F.lit(False)) & is_legacy(current=current)))


def page_after(pages: DataFrame, cursor: str | None = None, limit: int | None = None, prefix: str | None = None) -> DataFrame:
    """The next `limit` (1 to 200, 50 unless said) pages after a url, by url: nothing is skipped between calls."""
    from . import search

    rows = pages if cursor is None else pages.filter(F.col("url") > cursor)
    if prefix:
        rows = rows.filter(search.below(F.col("url"), prefix))
    return rows.orderBy("url").limit(min(200, max(1, 50 if limit is None else int(limit))))
