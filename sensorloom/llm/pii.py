"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

The four fixed kinds (email, ip, card, phone) are found leftmost and
non-overlapping per kind and always stay; the other kinds (IBAN with mod-97, US
social security and routing numbers) are added when their score, checksum and
nearby words together, is high enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing")
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
ALNUM = re.compile(r"[A-Za-z0-9]")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[a-zà-öø-ÿ]+")

#: Characters of an IBAN by country (SWIFT registry); of another country any length from 15 to 34 is tried.
IBAN_SIZE = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 "
    "NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}

#: Words near a span that speak for its kind, and words that speak against any.
FOR = {"email": "email mail e-mail contact correo", "ip": "ip address host server", "card": "card visa mastercard credit payment karte carte tarjeta",
       "phone": "phone tel telephone call mobile fax telefon teléfono", "iban": "iban bank account konto compte cuenta transfer",
       "ssn": "ssn social security", "routing": "routing aba bank transit"}
FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
AGAINST = frozenset("example sample test version isbn order invoice sku serial".split())
#: Score of a match whose checks hold, by kind, before its context; added kinds need MIN_SCORE.
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "routing": 0.2}
MIN_SCORE, NEAR = 0.6, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def aba(d: str) -> bool:
    return d != "0" * 9 and sum(w * int(c) for w, c in zip((3, 7, 1) * 3, d)) % 10 == 0


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each country and check digits with as many characters as the country's IBANs have (for others the
    most, up to the end of a word, that pass), if mod-97 holds; what follows is no part of it."""
    done = 0
    for m in IBAN.finditer(text):
        rest = IBAN_REST.match(text, m.end()) if m.start() >= done else None
        if not rest:
            continue
        ends = [i + 1 for i in range(m.start(), rest.end()) if text[i] != " "]  # end of the first n + 1 characters
        size = IBAN_SIZE.get(m[0][:2])
        for n in [size] if size else range(len(ends), 14, -1):
            if n <= len(ends) and not ALNUM.match(text, ends[n - 1]) and mod97(text[m.start():ends[n - 1]].replace(" ", "")):
                yield m.start(), ends[n - 1]
                done = ends[n - 1]
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it (after the last match) and a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the matches whose checks hold."""
    if "@" in text:
        for s, e in emails(text):
            yield 0, s, e
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 or len(p) > 3 and int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                yield 1, m.start(), m.end()
    for m in CARD.finditer(text):
        if 16 <= len(m[0]):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                yield 2, m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield 3, m.start(), m.end()
    for s, e in ibans(text):
        yield 4, s, e
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield 5, m.start(), m.end()
    for m in ROUTING.finditer(text):
        if aba(m[0]):
            yield 6, m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Start score of the kind, moved by the words within NEAR characters."""
    near = set(WORD.findall(text[max(0, start - NEAR):start].lower())) | set(WORD.findall(text[end:end + NEAR].lower()))
    return max(0.0, min(1.0, START[kind] + 0.4 * bool(near & FOR[kind]) - 0.3 * bool(near & AGAINST)))


def scan(text: str | None) -> list[dict]:
    """Spans by kind as listed in KINDS, then start."""
    if not text:
        return []
    out = []
    for k, start, end in sorted(proposals(text)):
        kind = KINDS[k]
        points = score(text, kind, start, end)
        if kind in BASE or points >= MIN_SCORE:
            out.append({"kind": kind, "start": start, "end": end, "score": points})
    return out


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([scan(t.as_py()) for t in texts], _TYPE)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: spans (kind, start and end in code points, score) of every whole text.  A
    null or empty text has none; repeated rows and null ids are returned as they are;
    an empty table gives no rows; other columns are ignored."""
    return docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(_scan, SPANS)(F.col(text_col)).alias("found"))
