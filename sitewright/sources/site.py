"""Where a site's pages come from: build output, robots rules, the scope of a run, and pages found by following links."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import scalars as S
from ..operators import pages as P

#: Build tools, the file that tells each, and the folder that holds its pages; the first that fits is taken.
OUTPUTS = (
    ("vercel", ".vercel/output/config.json", ".vercel/output/static"),
    ("cloudflare", ".svelte-kit/cloudflare/_worker.js", ".svelte-kit/cloudflare"),
    ("node", "build/handler.js", "build/prerendered"),
    ("netlify", ".netlify/server", "build"),
)
SAFE_NAME = re.compile(r"[A-Za-z0-9._-]+")


@dataclass(frozen=True)
class Output:
    tool: str
    folder: str


def detect_output(spark: SparkSession, root: str, static_dir: str = "build") -> Output | None:
    """The folder of prerendered pages below a project's root: of the first tool whose mark and folder are there, else the
    static folder if it has an index.html."""

    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
        return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))

    found = next((Output(tool, folder) for tool, mark, folder in OUTPUTS if there(mark) and there(folder)), None)
    return found or (Output("static", static_dir) if there(f"{static_dir}/index.html") else None)


def robots_of(spark: SparkSession, folder: str, agent: str) -> patterns.RobotsRules | None:
    """The rules of a folder's robots.txt for an agent; none where it cannot be read."""
    try:
        row = spark.read.text(f"{folder.rstrip('/')}/robots.txt", wholetext=True).first()
    except Exception:  # a file that is missing or unreadable says nothing
        return None
    return patterns.parse_robots(row.value, agent) if row else None


def assert_safe(what: str, name: str) -> str:
    """The name, if it can stand in record ids; else an error."""
    if not SAFE_NAME.fullmatch(name or ""):
        raise ValueError(f"{what} {name!r} may hold letters, digits, dots, dashes and underscores only")
    return name


def _sanitized(name: str) -> str:
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9._-]+", "-", name.lower()))[:80]


def resolve_scope(project: str, mode: str = "fixed", fixed: str = "main", variable: str = "", asked: str | None = None, folder: str | None = None, sanitize: bool = True, environment: Mapping[str, str] | None = None) -> tuple[str, str]:
    """project and scope name of a run: what is asked for, else a fixed name, an environment variable's value, or the
    branch of the repository in a folder (the fixed name where there is none). Names that are unsafe raise."""
    name = asked
    if name is None and mode == "env":
        name = (os.environ if environment is None else environment).get(variable)
        if not name:
            raise ValueError(f"the scope is taken from {variable}, which is not set")
    if name is None and mode == "git":
        try:
            told = subprocess.run(["git", "rev-parse", "--abbrev-ref", "HEAD"], cwd=folder, capture_output=True, text=True, check=True)
            name = told.stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            name = None
    name = fixed if name is None else name
    return assert_safe("project", project), assert_safe("scope", _sanitized(name) if sanitize else name)


@dataclass(frozen=True)
class Found:
    """pages: url, depth, html; failures: url, reason; limited_by: max-pages, max-depth or None."""

    pages: DataFrame
    failures: DataFrame
    limited_by: str | None


def discover(site: DataFrame, seeds: DataFrame, max_pages: int = 200, max_depth: int = 10, exclude: tuple[str, ...] = ()) -> Found:
    """Pages that can be reached from seeds (url) by links, wave by wave. site: url, html, status, content_type of what a
    server would answer; an address that it lacks, or a status other than 2xx, is a failure, an answer that is no HTML is
    passed over. Of a wave that would exceed max_pages the first by depth and url are taken."""
    spark = site.sparkSession
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()  # spark.checkpoint.dir sets it
    cut = lambda df: df.checkpoint() if checkpoints else df
    wanted = lambda df: df.filter(~patterns.matches_any(F.col("url"), list(exclude)))
    queue = cut(wanted(seeds.select(S.normalize_url_path(F.col("url")).alias("url")).distinct()).withColumn("depth", F.lit(0)))
    visited, parts, failed = queue.select("url"), [], []
    left, beyond = max(0, max_pages), False
    while left and not queue.isEmpty():
        wave = queue.orderBy("depth", "url").limit(left)
        got = cut(wave.join(site, "url", "left"))
        answered = (F.col("status") >= 200) & (F.col("status") < 300)
        failed.append(got.filter(~F.coalesce(answered, F.lit(False))).select("url", F.coalesce(F.col("status").cast("string"), F.lit("no answer")).alias("reason")))
        pages = cut(got.filter(answered & F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html"))).select("url", "depth", "html"))
        parts.append(pages)
        left -= pages.count()
        links = P.extract_pages(pages, drop=("script", "style")).select("url", F.explode("links.url").alias("to"))
        new = wanted(links.join(pages.select("url", "depth"), "url").groupBy(F.col("to").alias("url")).agg((F.min("depth") + 1).alias("depth")))
        new = cut(new.join(visited, "url", "left_anti"))
        beyond = beyond or not new.filter(F.col("depth") > max_depth).isEmpty()
        new = new.filter(F.col("depth") <= max_depth)
        visited = cut(visited.unionByName(new.select("url")))
        queue = cut(queue.join(wave.select("url"), "url", "left_anti").unionByName(new))
    none = spark.createDataFrame([], "url string, depth int, html string")
    pages, failures = none, spark.createDataFrame([], "url string, reason string")
    for part, bad in zip(parts, failed, strict=True):
        pages, failures = pages.unionByName(part), failures.unionByName(bad)
    limited = "max-pages" if not left and not queue.isEmpty() else "max-depth" if beyond else None
    return Found(pages, failures, limited)
