"""What a result list shows: target URLs, trails of a path and matching sections, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: The two query parameters that name a section and a phrase, and the longest phrase in words.
SECTION_KEY, PHRASE_KEY, PHRASE_WORDS = "_ssk", "_sskt", 12
#: Characters that a URI component keeps and a form field does not.
COMPONENT_KEEPS = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~", "+": "%20"}


def _component(x: Column) -> Column:
    out = F.url_encode(x)
    for code, kept in COMPONENT_KEEPS.items():
        out = F.replace(out, F.lit(code), F.lit(kept))
    return out


def _phrase(x: Column) -> Column:
    return S.normalize_text(F.regexp_replace(F.coalesce(x, F.lit("")), r"…|\.{3,}", " "))


def text_target(section: Column, snippet: Column) -> Column:
    """The phrase to scroll to: the snippet's first words if it names its section or has none, else the section."""
    title, said = _phrase(section), _phrase(snippet)
    tied = (said != "") & ((title == "") | F.contains(F.lower(said), F.lower(title)))
    return F.when(tied, F.array_join(F.slice(F.split(said, " "), 1, PHRASE_WORDS), " ")).otherwise(title)


def result_url(url: Column, section: Column, snippet: Column) -> Column:
    """The URL with section, phrase and text fragment; as it was if there is no phrase. A URL's own parameters stay in
    order, and those of the two names are replaced at the end."""
    target = text_target(section, snippet)
    whole = F.regexp_extract(url, "^([^#]*)", 1)
    anchor = F.regexp_replace(F.regexp_extract(url, "(#.*)$", 1), ":~:text=.*$", "")
    path, query = F.regexp_extract(whole, r"^([^?]*)", 1), F.regexp_extract(whole, r"\?(.*)$", 1)
    decoded = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    fields = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(SECTION_KEY, PHRASE_KEY))
    own = F.transform(fields, lambda p: F.concat(decoded(F.substring_index(p, "=", 1)), F.lit("="), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1))))
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(SECTION_KEY + "="), F.url_encode(section)))
    added = F.filter(F.array(named, F.concat(F.lit(PHRASE_KEY + "="), F.url_encode(target))), lambda p: p.isNotNull())
    ending = F.concat(F.when(anchor == "", F.lit("#")).otherwise(anchor), F.lit(":~:text="), _component(target))
    return F.when(target == "", url).otherwise(F.concat(path, F.lit("?"), F.array_join(F.concat(own, added), "&"), ending))


def breadcrumb(url: Column) -> Column:
    """/docs/getting-started.html as Docs / Getting Started; empty for the root and for index pages at it."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^index$|^(?i:index)\.\w+$"))

    def label(s: Column) -> Column:
        text = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        text = S.trim_blanks(F.regexp_replace(F.regexp_replace(text, r"\.\w+$", ""), "[-_]+", " "))
        words = F.split(text, r"(?<!\w)(?=\w)")  # each piece but perhaps the first starts a word
        return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\w"), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))).otherwise(w)), "")

    return F.array_join(F.filter(F.transform(parts, label), lambda s: s != ""), " / ")


def section_label(title: Column, section: Column) -> Column:
    """The section beside the title; null if it is blank or says what the title says."""
    s = S.trim_blanks(section)
    return F.when((s != "") & (F.lower(s) != F.lower(S.trim_blanks(F.coalesce(title, F.lit(""))))), s)


def sub_results(title: Column, section: Column, chunks: Column, most: int = 3) -> Column:
    """The first `most` chunks (structs with a field `section`) of sections that are neither shown already nor repeated."""
    key = lambda c: F.lower(S.trim_blanks(F.coalesce(c, F.lit(""))))
    shown = F.array(F.lit(""), key(title), key(section))
    fresh = F.filter(chunks, lambda c: ~F.array_contains(shown, key(c["section"])))
    keys = F.transform(fresh, lambda c: key(c["section"]))
    return F.slice(F.filter(fresh, lambda c, i: F.array_position(keys, key(c["section"])) == i + 1), 1, most)


def highlight_parts(text: Column, query: Column) -> Column:
    """array<struct(text, match)>: the text cut where words of the query stand, whatever their case."""
    words = F.array_sort(F.filter(F.split(S.normalize_text(query), " "), lambda w: w != ""), lambda a, b: F.length(b) - F.length(a))
    pattern = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\w\s])", r"\\$1")), "|")
    cut = F.split(F.regexp_replace(text, F.concat(F.lit("(?i)("), pattern, F.lit(")")), F.lit("\u0001$1\u0001")), "\u0001")
    parts = F.filter(F.transform(cut, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("match"))), lambda p: p["text"] != "")
    return F.when(pattern == "", F.array(F.struct(text.alias("text"), F.lit(False).alias("match")))).otherwise(parts)


def normalize_query(query: Column) -> Column:
    return S.normalize_text(query)


def wrap_index(index: Column, length: Column) -> Column:
    """An index taken round a list; -1 for an empty list."""
    return F.when(length <= 0, F.lit(-1)).otherwise(F.pmod(index, length)).cast("long")


def chunk_as_result(result: Column, chunk: Column) -> Column:
    """A result (struct) that shows one of its sections alone."""
    return result.withField("section_title", chunk["section_title"]).withField("snippet", chunk["snippet"]).dropFields("chunks")


def scroll_match(text: Column, needle: Column) -> Column:
    """struct(start, end), in characters from 0, of the first place in a text where the needle's words stand in a row,
    whatever is between them; else where they stand together without anything between. Null where they do not."""
    words = F.filter(F.split(needle, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    strict = F.concat(F.lit("(?iu)"), F.array_join(words, r"[^\p{L}\p{N}]+"))
    lenient = F.concat(F.lit("(?iu)"), F.array_join(words, r"[^\p{L}\p{N}]*"))
    signs = F.concat(F.lit("(?iu)"), F.regexp_replace(F.regexp_replace(needle, r"([^\s\w])", r"\\$1"), r"\s+", r"\\s+"))
    tries = [(F.size(words) > 0, strict), (F.size(words) > 1, lenient), ((F.size(words) == 0) & (needle != ""), signs)]
    spans = []
    for holds, pattern in tries:
        found = F.regexp_substr(text, pattern)
        start = F.regexp_instr(text, pattern) - 1
        spans.append(F.when(holds & found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end"))))
    return F.coalesce(*spans)
