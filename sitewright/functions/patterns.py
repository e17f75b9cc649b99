"""URL patterns, robots rules and route patterns, compiled on the driver into Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(pattern: str) -> str:
    return pattern[:-1] if pattern != "/" and pattern.endswith("/") else pattern


def matches(url: Column, pattern: str) -> Column:
    """Exact, /p/* (one more segment) or /p/** (p and all below); a slash at the url's end says nothing. The url is named
    once, so generated code stays small."""
    p = _bare(pattern)
    if p.endswith("/**"):
        return F.lit(True) if p == "/**" else url.rlike(f"(?s)^{re.escape(p[:-3])}(/.*)?$")
    if p.endswith("/*"):
        return url.rlike(f"^{re.escape(p[:-2])}/[^/]+/?$")
    return url == "/" if p == "/" else url.rlike(f"^{re.escape(p)}/?$")


def matches_any(url: Column, patterns: list[str]) -> Column:
    return reduce(or_, (matches(url, p) for p in patterns), F.lit(False))


def weight_for(url: Column, weights: dict[str, float]) -> Column:
    """The weight of the longest pattern that matches; 1 if none does."""
    out = F.lit(None).cast("double")
    for pattern in sorted(weights, key=lambda p: (len(p), p)):
        out = F.when(matches(url, pattern), F.lit(float(weights[pattern]))).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def effective_weight(url: Column, own: Column, weights: dict[str, float]) -> Column:
    """A page's own weight, else the configured one; 0 if either says that the page is left out."""
    chosen = F.transform(F.array(weight_for(url, weights)), lambda config: F.when(config == 0, F.lit(0.0)).otherwise(F.coalesce(own.cast("double"), config)))
    return F.get(chosen, F.lit(0))


@dataclass(frozen=True)
class RobotsRules:
    disallow: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()


def parse_robots(content: str, agent: str) -> RobotsRules:
    """The rules of the agent's own group if it has any that say something, else those of *. Agent lines in a row share a
    group; a rule without a value says nothing."""
    groups: dict[str, list[tuple[str, str]]] = {}
    agents: list[str] = []
    open_ = False
    for line in content.splitlines():
        name, colon, value = line.partition("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif name in ("allow", "disallow"):
            open_ = False
            for a in agents if value else ():
                groups[a].append((name, value))
    rules = groups.get(agent.lower()) or groups.get("*", [])
    return RobotsRules(*(tuple(v for n, v in rules if n == kind) for kind in ("disallow", "allow")))


def blocked_by_robots(path: Column, rules: RobotsRules) -> Column:
    """The longest disallowed prefix against the longest allowed one; a tie allows."""
    longest = lambda prefixes: F.greatest(F.lit(0), F.lit(0), *[F.when(F.startswith(path, F.lit(p)), F.lit(len(p))).otherwise(F.lit(0)) for p in prefixes])
    return longest(rules.disallow) > longest(rules.allow)


@dataclass(frozen=True)
class Route:
    file: str
    regex: str
    score: int


def route_of(file: str) -> Route:
    """A route file's path pattern and how specific it is."""
    inner = re.sub(r"/?\+page\.[^/]+$", "", re.sub(r"^src/routes/?", "", file))
    regex, score = "", 0
    parts = [s for s in inner.split("/") if s]
    for s in parts:
        if s.startswith("(") and s.endswith(")"):
            continue
        for form, piece, points in ((r"\[\[\.\.\.[^\]]+\]\]", "(?:/.+)?", -2), (r"\[\.\.\.[^\]]+\]", "/.+", 0), (r"\[\[[^\]]+\]\]", "(?:/[^/]+)?", -1), (r"\[[^\]]+\]", "/[^/]+", 3)):
            if re.fullmatch(form, s):
                regex, score = regex + piece, score + points
                break
        else:
            regex, score = regex + "/" + re.sub(r"([^\w/-])", r"\\\1", s), score + 10
    return Route(file, f"^{regex if parts else '/'}/?$", score)


def route_for(url: Column, files: list[str]) -> Column:
    """struct(route_file, resolution): the most specific route that matches, else the root file as best effort. The
    patterns are few and known to the driver, so they become one CASE and no join."""
    routes = sorted(map(route_of, files), key=lambda r: (-r.score, -len(r.file), r.file))
    root = next((r.file for r in routes if r.regex == "^//?$"), routes[0].file if routes else "src/routes/+page.svelte")
    out = F.struct(F.lit(root).alias("route_file"), F.lit("best-effort").alias("resolution"))
    for r in reversed(routes):
        out = F.when(url.rlike(r.regex), F.struct(F.lit(r.file).alias("route_file"), F.lit("exact").alias("resolution"))).otherwise(out)
    return out
