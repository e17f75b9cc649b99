"""Markdown files with front matter, as pages."""

from __future__ import annotations

import datetime
import math
import re

import yaml

from .chunking import FENCE

FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)
NOINDEX = re.compile(r"<!--\s*noindex\s*-->", re.I)
#: Fixed value: the fields that may hold a page's date, first to last.
DATE_FIELDS = ("date", "publishedAt", "updatedAt", "published_at", "updated_at")
META_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def front_matter(text: str) -> tuple[dict, str]:
    """The fields and the rest. Front matter that is not YAML, or no mapping, gives no fields and is dropped."""
    m = FRONT.match(text)
    if not m:
        return {}, text
    try:
        fields = yaml.safe_load(m[1])
    except yaml.YAMLError:
        fields = None
    return (fields if isinstance(fields, dict) else {}), text[m.end() :]


def comment_noindex(text: str) -> bool:
    fenced = False
    for line in text.splitlines():
        if FENCE.match(line.strip()):
            fenced = not fenced
        elif not fenced and NOINDEX.search(line):
            return True
    return False


def milliseconds(value: object) -> int | None:
    """A date, a date's text or a number of milliseconds; null for anything else. No zone means UTC."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int | float):
        return int(value) if math.isfinite(value) else None
    if isinstance(value, str):
        try:
            value = datetime.datetime.fromisoformat(value.strip())
        except ValueError:
            return None
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        value = datetime.datetime(value.year, value.month, value.day)
    if not isinstance(value, datetime.datetime):
        return None
    zoned = value if value.tzinfo else value.replace(tzinfo=datetime.UTC)
    return round(zoned.timestamp() * 1000)


def _meta(value: object) -> str | None:
    if isinstance(value, list):
        return ",".join(value) if all(isinstance(v, str) for v in value) else None
    if isinstance(value, datetime.date):
        return str(milliseconds(value))
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, str | int | float) else None


def extract(url: str, text: str | None, title: str | None = None, prefix: str = "search") -> dict:
    """prefix: the front matter field that holds a site's own settings (noindex, weight, meta)."""
    out = {"status": "indexed", "reason": None, "title": url, "markdown": None, "description": None, "keywords": [], "tags": [], "weight": None, "published_ms": None, "meta": {}}
    text = text or ""
    if comment_noindex(text):
        return out | {"status": "excluded", "reason": "noindex"}
    fields, body = front_matter(text)
    own = fields.get(prefix) if isinstance(fields.get(prefix), dict) else {}
    if fields.get("noindex") is True or own.get("noindex") is True:
        return out | {"status": "excluded", "reason": "noindex"}
    weight = own["weight"] if own.get("weight") is not None else fields.get(f"{prefix}Weight")
    if isinstance(weight, int | float) and not isinstance(weight, bool) and math.isfinite(weight) and weight >= 0:
        out["weight"] = float(weight)
        if weight == 0:
            return out | {"status": "excluded", "reason": "zero-weight"}
    body = re.sub(r"[ \t]+$", "", body.replace("\r\n", "\n"), flags=re.M).strip()
    if not body:
        return out | {"status": "failed", "reason": "empty-content"}
    words = fields.get("keywords")
    words = words.split(",") if isinstance(words, str) else words if isinstance(words, list) else []
    said = fields.get("description")
    meta = own.get("meta") if isinstance(own.get("meta"), dict) else {}
    return out | {
        "title": title if title is not None else fields["title"] if isinstance(fields.get("title"), str) else url,
        "markdown": body + "\n",
        "description": (said.strip() or None) if isinstance(said, str) else None,
        "keywords": [w.strip() for w in words if isinstance(w, str) and w.strip()],
        "tags": [s for s in url.split("/") if s][:1],
        "published_ms": next((t for t in map(milliseconds, map(fields.get, DATE_FIELDS)) if t is not None), None),
        "meta": {k: v for k, v in ((str(k), _meta(v)) for k, v in meta.items() if META_KEY.fullmatch(str(k))) if v is not None},
    }
