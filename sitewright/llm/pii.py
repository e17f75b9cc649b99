"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds the anchors: at-signs, plus signs, digits, schemes and identifier cues.
At each anchor a local parser grows the span to both sides and checks it: no parser looks further than the characters
that may belong to its span, so the work stays in proportion to the text, whatever it holds.

Base kinds are the leftmost spans of the documented patterns, without overlap in their kind; a span whose check fails
is dropped and takes its characters with it. The anchors add kinds that the patterns alone do not see: `tel` (number after
the scheme tel: or a cue such as phone:), `iban`, `ssn`, `routing` and `account` (after a cue in one of four languages,
with valid form, and check digits where there are any), and `login` (user and password of a URL). Cues and accounts are
read in small and capital letters alike; an IBAN ends at a word's end where its check digits hold, whatever words
follow: at its country's length, else at the last such end. Offsets count code points, ends are exclusive.

Defined results: a null text is empty and has no spans; ids may be null or repeat; each row is judged by itself;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("tel", "iban", "ssn", "login", "account", "routing")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TEL = re.compile(r"[ \t]{0,3}([0-9](?:[().-]?[0-9]){6,14})(?![0-9])")
IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", re.I | re.A)
SSN = re.compile(r"[\s:#=]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+(?=@)")
GAP = r"[\s.:#=]{0,3}(?:(?:no|nr|num|number|nummer)\b[\s.:#=]{0,3})?"
ACCOUNT = re.compile(GAP + r"([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I | re.A)
ROUTING = re.compile(GAP + r"([0-9]{9})(?![0-9])", re.I | re.A)
CUES = {
    "login": ("://",),
    "tel": ("tel:", "phone:", "mobile:", "fax:", "telefon:", "tél:", "téléphone:", "teléfono:"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security number", "social security no"),
    "account": ("account number", "account no", "acct", "a/c", "kontonummer", "konto-nr", "numéro de compte", "número de cuenta"),
    "routing": ("routing number", "routing no", "aba no", "aba number"),
}
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZÉÚ", "abcdefghijklmnopqrstuvwxyzéú")  # keeps all offsets


#: Characters of an account by country.
LENGTHS = {c: int(n) for c, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 "
    "LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
).split())}


ANCHORS = {cue: kind for kind, cues in CUES.items() for cue in cues}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def routing_ok(digits: str) -> bool:
    return sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0 and digits != "000000000"


def iban_end(text: str, start: int, end: int) -> int | None:
    """The end of a valid account that begins at start, at the end of a word: of its country's length, else the longest."""
    ends = [at for at in range(end, start + 14, -1) if text[at - 1] != " " and not (at < len(text) and text[at].isascii() and text[at].isalnum())]
    own = LENGTHS.get(text[start : start + 2].upper())
    ends.sort(key=lambda at: at - start - text.count(" ", start, at) != own)  # stable: longest first among equals
    return next((at for at in ends if iban_ok(text[start:at])), None)


class Finder:
    """Anchors by automaton, spans by parser."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        for sign in ("@", "+", *"0123456789", *ANCHORS):
            self.anchors.add_word(sign, sign)
        self.anchors.make_automaton()

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
        email_end = ip_end = card_end = phone_end = 0
        low = text.lower()
        if len(low) != len(text):  # a letter that becomes two would move all offsets
            low = text.translate(SMALL)
        for last, sign in self.anchors.iter(low):
            if "0" <= sign <= "9":
                if last >= card_end:
                    card_end = last + 1
                    if m := CARD.match(text, last):
                        card_end = m.end()
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
                if last >= ip_end:
                    if m := IP.match(text, last):
                        ip_end = m.end()
                        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                            found["ip"].append(m.span())
                    else:
                        ip_end = DIGITS.match(text, last).end()
            elif sign == "@":
                start = last
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < last and (m := DOMAIN.match(text, last + 1)):
                    found["email"].append((start, m.end()))
                    email_end = m.end()
            elif sign == "+":
                if last >= phone_end and (m := PHONE.match(text, last)):
                    phone_end = m.end()
                    if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                        found["phone"].append(m.span())
            else:
                self._cue(text, last + 1, ANCHORS[sign], found)
        return found

    def _cue(self, text: str, at: int, kind: str, found: dict) -> None:
        span = None
        if kind == "tel" and (m := TEL.match(text, at)):
            span = m.span(1)
        elif kind == "iban" and (m := IBAN.match(text, at)) and (end := iban_end(text, m.start(1), m.end(1))):
            span = (m.start(1), end)
        elif kind == "ssn" and (m := SSN.match(text, at)):
            span = m.span(1)
        elif kind == "login" and (m := LOGIN.match(text, at)):
            span = m.span()
        elif kind == "account" and (m := ACCOUNT.match(text, at)):
            span = m.span(1)
        elif kind == "routing" and (m := ROUTING.match(text, at)) and routing_ok(m[1]):
            span = m.span(1)
        if span and (not found[kind] or found[kind][-1][1] <= span[0]):  # two cues may lead to one span
            found[kind].append(span)


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, a digest of the base spans, and all spans of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch, (texts,) in arrow_rows(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            for text in texts:
                found = finder.spans(text or "")
                for k, kind in enumerate(BASE_KINDS):
                    out[k].append(len(found[kind]))
                out[4].append(hashlib.sha256(listed(found, BASE_KINDS).encode()).hexdigest())
                out[5].append(listed(found, (*BASE_KINDS, *ADDED_KINDS)))
                out[6].append(sum(len(found[k]) for k in ADDED_KINDS))
                out[7].append(sum(map(len, found.values())))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64()), pa.array(out[7], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, SCHEMA)


def redact(text: str | None, finder: Finder | None = None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if text is None:
        return None
    found = (finder or Finder()).spans(text)
    spans = sorted((a, -b, k) for k, s in found.items() for a, b in s)
    out, at = [], 0
    for a, neg, kind in spans:
        if a >= at:
            out.append(f"{text[at:a]}[{kind}]")
        at = max(at, -neg)
    return "".join(out) + text[at:]
