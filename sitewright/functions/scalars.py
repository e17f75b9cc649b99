"""Scalar functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STOP_ANCHORS = ("here", "click", "click here", "read more", "link", "this", "more")
MILLISECONDS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
SNIPPET_LENGTH = 220
SUMMARY_LENGTH = 3500
CHUNK_TEXT_LENGTH = 30_000
SCHEMA_VERSION = 1


def trim_blanks(x: Column) -> Column:
    """SQL trim knows spaces only; this takes every blank."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalize_text(x: Column) -> Column:
    return trim_blanks(F.regexp_replace(x, r"\s+", " "))


def normalize_markdown(x: Column) -> Column:
    lines = F.regexp_replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), r"(?m)[ \t]+$", "")
    return F.concat(trim_blanks(lines), F.lit("\n"))


def sanitize_scope(x: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit(80))


def markdown_to_plain(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?s)```.*?```", " ")
    x = F.regexp_replace(x, r"`([^`]+)`", "$1")
    return normalize_text(F.regexp_replace(x, r"[#>*_|\-]", " "))


def snippet(x: Column, length: int = SNIPPET_LENGTH) -> Column:
    plain = markdown_to_plain(x)
    return F.when(F.length(plain) <= length, plain).otherwise(F.concat(trim_blanks(F.left(plain, F.lit(length - 1))), F.lit("…")))


def normalize_url_path(x: Column) -> Column:
    """One leading slash, no doubled and no trailing ones. x is named once, so generated code stays small."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), trim_blanks(x)), "/+", "/"), "(.)/$", "$1")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_depth(x: Column) -> Column:
    return F.size(segments(normalize_url_path(x)))


def humanize_url_path(x: Column) -> Column:
    return F.array_join(F.transform(segments(normalize_url_path(x)), lambda s: F.regexp_replace(s, "[-_]", " ")), " / ")


def html_file_to_url(relative: Column) -> Column:
    return (
        F.when(relative == "index.html", F.lit("/"))
        .when(F.endswith(relative, F.lit("/index.html")), normalize_url_path(F.regexp_replace(relative, r"/index\.html$", "")))
        .otherwise(normalize_url_path(F.regexp_replace(relative, r"\.html$", "")))
    )


def content_file_to_url(relative: Column) -> Column:
    """Content files: extension and index go. Route files: groups go, parameters become their names."""
    route = F.regexp_replace(F.regexp_replace(relative, "^src/routes/?", ""), r"/?\+page\.[^/]+$", "")
    parts = F.filter(F.split(route, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda s: F.when(s.rlike(r"^\[\[[^\]]+\]\]$"), F.lit("optional")).when(s.rlike(r"^\[\.\.\.[^\]]+\]$"), F.lit("splat")).when(s.rlike(r"^\[[^\]]+\]$"), F.lit("param")).otherwise(s))
    plain = F.regexp_replace(F.regexp_replace(relative, r"\.md$", ""), "(^|/)index$", "")
    return F.when(F.startswith(relative, F.lit("src/routes")), normalize_url_path(F.array_join(named, "/"))).otherwise(normalize_url_path(plain))


def resolve_path(x: Column) -> Column:
    """Absolute URL to its path; anything else is cut at ? or #."""
    inner = F.when(x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.regexp_extract(x, r"^[^:]+://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_replace(x, "[?#].*$", ""))
    return normalize_url_path(inner)


def normalize_title(x: Column) -> Column:
    return normalize_text(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", ""))


def matches_either_way(a: Column, b: Column) -> Column:
    a, b = normalize_title(a), normalize_title(b)
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def normalize_anchor(x: Column) -> Column:
    x = F.lower(normalize_text(x))
    return F.when((F.length(x) < 3) | x.isin(*STOP_ANCHORS), F.lit("")).otherwise(F.left(x, F.lit(100)))


def non_negative_or_zero(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))


def duration_ms(x: Column) -> Column:
    """30d, 12h, 15m, 45s or 500ms; null for anything else."""
    form = r"(?i)^(\d+)(ms|s|m|h|d)$"
    x = trim_blanks(x)
    unit = F.lower(F.regexp_extract(x, form, 2))
    scale = F.coalesce(*[F.when(unit == u, F.lit(n)) for u, n in MILLISECONDS.items()])
    return F.when(x.rlike(form), F.regexp_extract(x, form, 1).try_cast("long") * scale)


def date_to_ms(x: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(x))


def meta_value(kind: Column, raw: Column) -> Column:
    """A typed meta value as struct(kind, s, d, b, a)."""
    number = raw.try_cast("double")
    truth = F.lower(raw).isin("true", "1", "yes")
    parts = F.filter(F.transform(F.split(raw, ","), lambda v: trim_blanks(v)), lambda v: v != "")
    return F.struct(
        kind.alias("kind"),
        F.when(~kind.isin("number", "boolean", "string[]", "date"), raw).alias("s"),
        F.when(kind == "number", number).when(kind == "date", date_to_ms(raw).cast("double")).alias("d"),
        F.when(kind == "boolean", truth).alias("b"),
        F.when(kind == "string[]", parts).alias("a"),
    )


def page_summary(title: Column, description: Column, keywords: Column, markdown: Column, length: int = SUMMARY_LENGTH) -> Column:
    body = F.regexp_replace(markdown, r"(?s)```.*?```", " ")
    body = F.regexp_replace(body, r"`([^`]+)`", "$1")
    body = F.regexp_replace(body, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    body = F.regexp_replace(body, r"(?m)^#{1,6}\s+", "")
    body = normalize_text(F.regexp_replace(body, r"[>*_|~\-]", " "))
    filled = lambda c: F.when(c != "", c)
    joined = F.concat_ws("\n\n", title, filled(description), filled(F.array_join(keywords, ", ")), filled(body))
    return F.when(F.length(joined) <= length, joined).otherwise(trim_blanks(F.left(joined, F.lit(length))))


def page_hash(title: Column, description: Column, keywords: Column, tags: Column, markdown: Column, n_links: Column, published: Column, anchor: Column, custom: Column, weight: Column, link_urls: Column, meta_json: Column) -> Column:
    """SHA-256 over the parts that make a page's stored record, in fixed order."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    parts = [text(title), text(description), listed(keywords), listed(tags), text(markdown), text(n_links), text(published), text(anchor), F.when(custom, F.lit("custom")).otherwise(F.lit("site")), text(weight), listed(link_urls), text(meta_json)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def encode_component(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def record_prefix(project: Column, scope: Column, kind: str) -> Column:
    """The fixed layout of stored ids: layout name, version, project, scope, kind."""
    return F.concat(F.lit(f"ss:{SCHEMA_VERSION}:"), project, F.lit(":"), scope, F.lit(f":{kind}:"))


def page_id(project: Column, scope: Column, url: Column) -> Column:
    return F.concat(record_prefix(project, scope, "page"), encode_component(url))


def key_of_record(record_id: Column, project: Column, scope: Column, kind: str) -> Column:
    """What follows the prefix of a record id; null for ids of another scope, kind or layout."""
    prefix = record_prefix(project, scope, kind)
    return F.when(F.startswith(record_id, prefix), F.substring(record_id, F.length(prefix) + 1, F.length(record_id)))


def url_of_page_id(record_id: Column, project: Column, scope: Column) -> Column:
    """The url in a page's record id; null where that is no id of the scope's pages, or cannot be decoded."""
    key = key_of_record(record_id, project, scope, "page")
    return F.try_url_decode(F.replace(key, F.lit("+"), F.lit("%2B")))


def safe_literal(text: str) -> str:
    """Text that may stand between quotes in a filter; a quote or backslash is an error."""
    if "'" in text or "\\" in text:
        raise ValueError("a quote or backslash cannot stand in a filter's text")
    return text


def valid_meta_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), F.lit(False))


def meta_content(value: Column) -> Column:
    """The text that a typed value (as of meta_value) is written as; dates as milliseconds."""
    whole = F.when(value["d"] == F.floor(value["d"]), value["d"].cast("long").cast("string")).otherwise(value["d"].cast("string"))
    return F.coalesce(F.when(value["kind"] == "string[]", F.array_join(value["a"], ",")), value["b"].cast("string"), whole, value["s"])


def safe_json(text: Column, schema: str, fallback: Column) -> Column:
    """The value of a JSON text; the fallback for text that is none."""
    return F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), fallback)


def chunk_key(url: Column, headings: Column, text: Column, nth: Column) -> Column:
    """Key of a chunk from what it says, not from where it stands."""
    cleaned = F.transform(headings, lambda h: F.lower(trim_blanks(h)))
    return F.sha1(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("v"), F.lit("chunk").alias("kind"), url.alias("url"), cleaned.alias("headings"), F.sha1(text).alias("text"), nth.alias("n"))))


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat(title, F.when(section.isNotNull() & (section != ""), F.concat(F.lit(" — "), section)).otherwise(F.lit("")), F.lit("\n\n"), text)


#: What a backend failure means, by status, then by whole words of its message; what stands first decides.
STATUS_CLASSES = {"UNAUTHORIZED": (401, 403), "RATE_LIMITED": (429,), "TIMEOUT": (408, 504)}
MESSAGE_CLASSES = {
    "NAMESPACE_MISSING": ("unknown namespace", "missing namespace", "namespace not found"),
    "UNAUTHORIZED": ("credentials", "forbidden", "permission", "token", "unauthorized"),
    "RATE_LIMITED": ("quota", "rate limit", "slow down", "throttled", "too many"),
    "TIMEOUT": ("deadline", "timed out", "timeout"),
    "INVALID_FILTER": ("filter", "parse", "syntax"),
    "SERVICE_UNAVAILABLE": ("connection", "fetch failed", "gateway", "host", "network", "refused", "reset", "unavailable"),
}


def error_class(status: Column, message: Column) -> Column:
    """What a backend failure means to a caller. A missing namespace is told by its message whatever the status; else a
    status that says something decides before the message does."""
    said = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))
    says = lambda words: reduce(or_, [F.contains(said, F.lit(f" {w} ")) for w in words])
    by_status = [(status.isin(*codes), name) for name, codes in STATUS_CLASSES.items()] + [(status >= 500, "SERVICE_UNAVAILABLE")]
    by_message = [(says(words), name) for name, words in MESSAGE_CLASSES.items()]
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in [by_message[0], *by_status, *by_message[1:]]], F.lit("UNKNOWN"))


def retryable(code: Column) -> Column:
    return code.isin("RATE_LIMITED", "TIMEOUT", "SERVICE_UNAVAILABLE")


def join_url(base: Column, route: Column) -> Column:
    """Base without slashes at its end, then the route with one leading slash."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(F.startswith(route, F.lit("/")), route).otherwise(F.concat(F.lit("/"), route)))


def clamp_int(x: Column, least: int, most: int, default: int) -> Column:
    """A whole number within bounds; the default for null, NaN and infinities."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.floor(x)))).cast("long")


def dice_path(a: Column, b: Column) -> Column:
    """Shared leading segments of two paths, twice their number by the number of all."""
    x, y = segments(a), segments(b)
    start = F.struct(F.lit(True).alias("go"), F.lit(0).alias("n"))
    step = lambda s, e: F.when(s["go"] & (e["l"] == e["r"]), F.struct(F.lit(True).alias("go"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("go"), s["n"].alias("n")))
    shared = F.aggregate(F.zip_with(x, y, lambda p, q: F.struct(F.coalesce(p, F.lit("\0l")).alias("l"), F.coalesce(q, F.lit("\0r")).alias("r"))), start, step, lambda s: s["n"])
    return F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
