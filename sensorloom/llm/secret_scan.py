"""Secret scan: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax (``name = "literal"``,
``name: literal``, ``"name": "literal"``, ``a = b + "literal"``) into name and literal pairs, carries constants to
the names they are assigned to later, and scores each literal by how sensitive
the names that receive it are and by how random its longest part without blanks looks
(all of it where the name ends like a password's, as that may be a passphrase).
Literals have no greatest length; triple-quoted and PEM ones go on over lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

NAME_AND_SIGN = re.compile(r"""(?<![\w.$-])["'\[]{0,2}([A-Za-z_][\w.-]*+)["'\]]{0,2}[ \t]*+(\+=|:=|=>|=(?![=>])|:(?![:/]))[ \t]*+""", re.A)
#: A quoted literal ends with its line, but for escaped line ends, PEM blocks and triple quotes.
QUOTED = re.compile(r"""(?:[rbfu]{1,2})?(?:\"{3}((?:[^"\\]++|\\[\s\S]|"(?!""))*+)\"{3}|'{3}((?:[^'\\]++|\\[\s\S]|'(?!''))*+)'{3}"""
                    r"""|"(-----BEGIN[^"]*+|(?:[^"\\\n]++|\\(?:\r\n|[\s\S]))*+)"|'(-----BEGIN[^']*+|(?:[^'\\\n]++|\\(?:\r\n|[\s\S]))*+)'|`(-----BEGIN[^`]*+|[^`\n]*+)`)""", re.A)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""", re.A)
#: How random a literal looks is told by so many characters of it.
LOOKS = 1024
PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\"'`A-Za-z_])")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a part of a name, or two joined parts, is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
             "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9, "auth": 0.7,
             "bearer": 0.8, "pass": 0.55, "pin": 0.55, "key": 0.55, "salt": 0.7, "dsn": 0.6, "connectionstring": 0.6, "cookie": 0.6, "session": 0.6}
#: The same for values that are digits alone.
NUMBERS = {"pin": 0.75}
#: Names that end so may hold words with blanks between.
PHRASE = frozenset(("password", "passwd", "pwd", "passphrase"))
PLACEHOLDER = re.compile(r"(?i)example|changeme|change_me|placeholder|dummy|your[_-]|^x+$|^\*+$|^\.+$|^<.*>$|^\$\{?\w+\}?$|^(true|false|null|none|undefined)$")


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in PARTS.findall(name)]


def name_score(name: str, table: dict[str, float] | None = None) -> float:
    parts = name_parts(name)
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max(((table or SENSITIVE).get(p, 0.0) for p in joined), default=0.0)


class Value(NamedTuple):
    """What tells how random a text looks, without the text; that of two texts one after the other follows from theirs.

    A run is its length and its first ``LOOKS`` characters.  ``lead`` and ``tail`` are the runs without blanks at the ends (both
    all of it, where there is no blank), ``best`` is the longest of all, ``whole`` the text without ``before`` and ``after``, the blanks at its ends."""
    lead: tuple[int, str]
    tail: tuple[int, str]
    best: tuple[int, str]
    whole: tuple[int, str]
    before: str
    after: str
    blank: bool
    last: str


NOTHING = Value((0, ""), (0, ""), (0, ""), (0, ""), "", "", False, "")


def _run(text: str) -> tuple[int, str]:
    return len(text), text[:LOOKS]


def _then(a: tuple[int, str], b: tuple[int, str]) -> tuple[int, str]:
    return a[0] + b[0], a[1] if len(a[1]) >= LOOKS or not b[1] else a[1] + b[1][:LOOKS - len(a[1])]


def value_of(text: str) -> Value:
    parts, whole = text.split(), text.strip()
    if not parts:
        return NOTHING._replace(before=text[:LOOKS], blank=text != "")
    before, after = text[:len(text) - len(text.lstrip())], text[len(text.rstrip()):]
    lead = (0, "") if before else _run(parts[0])
    tail = (0, "") if after else _run(parts[-1])
    return Value(lead, tail, _run(max(parts, key=len)), _run(whole), before[:LOOKS], after[:LOOKS], len(parts) > 1 or len(whole) < len(text), whole[-1])


def followed_by(a: Value, b: Value) -> Value:
    """The value of two texts one after the other; of equally long runs the first is the best."""
    middle = _then(a.tail, b.lead)
    best = max(a.best, middle, b.best, key=lambda r: r[0])
    lead, tail = a.lead if a.blank else middle, b.tail if b.blank else middle
    if not a.whole[0]:
        return Value(lead, tail, best, b.whole, (a.before + b.before)[:LOOKS], b.after, a.blank or b.blank, b.last)
    if not b.whole[0]:
        return Value(lead, tail, best, a.whole, a.before, (a.after + b.before)[:LOOKS], a.blank or b.blank, a.last)
    whole = _then(_then(a.whole, _run(a.after + b.before)), b.whole)
    return Value(lead, tail, best, whole, a.before, b.after, a.blank or b.blank, b.last)


def part_score(part: str) -> float:
    """Length, spread of characters, mixed classes; 0 for placeholders."""
    if len(part) < 8 or PLACEHOLDER.search(part):
        return 0.0
    n = len(part)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(part).values())
    classes = sum(bool(re.search(c, part)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.6 * bits / math.log2(max(n, 9)) + 0.15 * classes)


def secret_score(name: str, value: Value, known: dict[str, float]) -> float:
    """How sensitive the name is, times how much like a secret the value's longest run without blanks looks (all of it, where the
    name ends like a password's); 0 between pointed brackets."""
    sensitive = name_score(name)
    if not sensitive or not value.whole[0] or value.whole[1][0] == "<" and value.last == ">":
        return 0.0
    part = (value.whole if name_parts(name)[-1] in PHRASE else value.best)[1]
    if part.isdigit():
        sensitive = max(sensitive, name_score(name, NUMBERS))
    if part not in known:
        if len(known) > 500:
            known.clear()
        known[part] = part_score(part)
    return sensitive * known[part]


def literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of each literal assigned to a name, with the
    most sensitive name that it reaches.

    An assignment is a node: its own literals, and links to the earlier nodes of the constants it takes in.  A node's value is made from
    those of its operands, never from their texts, and scored once; then scores go back along the links."""
    constants: dict[str, tuple[int, Value]] = {}
    own: list[list[tuple[int, int]]] = []
    links: list[list[int]] = []
    best: list[tuple[float, str]] = []
    known: dict[str, float] = {}
    longest = 0
    regions = [(0, len(text))]  # the text, then the insides of literals of several lines
    for at, stop in regions:
        lo = hi = at  # the last run of bare characters right after a sign
        ends: dict[int, int] = {}
        while m := NAME_AND_SIGN.search(text, at, stop):
            name, pos = m[1], m.end()
            spans, taken, value = [], [], NOTHING
            if m[2] == "+=" and name in constants:
                taken.append(constants[name][0])
                value = constants[name][1]
            at = m.end()
            while True:
                if operand := QUOTED.match(text, pos, stop):
                    start, end = operand.span(operand.lastindex)
                    spans.append((start, end))
                    value = followed_by(value, value_of(text[start:end]))
                    at = pos = operand.end()  # what is quoted is no code
                    if text.find("\n", start, end) >= 0:
                        regions.append((start, end))
                else:
                    if not lo <= pos < hi:
                        if pos not in ends:
                            bare = BARE.match(text, pos, stop)
                            if not bare:
                                break
                            ends[pos] = bare.end()
                        if pos == m.end():
                            lo, hi = pos, ends[pos]
                    start, pos = pos, hi if lo <= pos < hi else ends[pos]
                    if pos - start <= longest and text[start:pos] in constants:
                        node, more = constants[text[start:pos]]
                        taken.append(node)
                        value = followed_by(value, more)
                    else:
                        end = pos
                        while end > start and text[end - 1] in ".,:":
                            end -= 1
                        spans.append((start, end))
                        head = text[start:min(end, start + LOOKS)]  # bare characters have no blanks
                        run = (end - start, head)
                        value = followed_by(value, Value(run, run, run, run, "", "", False, text[end - 1]) if head else NOTHING)
                plus = PLUS.match(text, pos, stop)
                if not plus:
                    break
                pos = plus.end()
            constants[name] = (len(own), value)
            longest = max(longest, len(name))
            own.append(spans)
            links.append(taken)
            best.append((secret_score(name, value, known), name))
    out: dict[tuple[int, int], tuple[float, str]] = {}
    for node in range(len(own) - 1, -1, -1):  # later nodes link to earlier ones
        score = best[node]
        for other in links[node]:
            if score[0] > best[other][0]:
                best[other] = score
        for start, end in own[node]:
            if end > start and score[0] > out.get((start, end), (0.0, ""))[0]:
                out[start, end] = score
    return [(s, e, name, score) for (s, e), (score, name) in sorted(out.items())]


def scan(text: str | None, threshold: float = 0.5) -> list[dict]:
    """Spans by start, then kind: the fixed patterns, leftmost and non-overlapping per
    kind, and the lexer's literals that no fixed span covers whole."""
    if not text:
        return []
    out = [(m.start(), 0, m.end(), 1.0, None) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end(), 1.0, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), 1.0, None) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        fixed = sorted((x[0], x[2]) for x in out)
        reach = list(accumulate((e for _, e in fixed), max))  # where the spans up to each one end at most
        for start, end, name, score in literals(text):
            k = bisect_right(fixed, (start, len(text))) - 1
            if score >= threshold and (k < 0 or reach[k] < end):
                out.append((start, 3, end, score, name))
    return [{"kind": KINDS[k], "start": s, "end": e, "score": sc, "name": name} for s, k, e, sc, name in sorted(out, key=lambda x: x[:3])]


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    spans = scan(text)
    if not spans:
        return text
    out, pos, end = [], 0, 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= end:
            out += [text[pos:s["start"]], mark]
        end = max(end, s["end"])
        pos = end
    return "".join(out) + text[pos:]


SPANS = "array<struct<kind:string,start:long,end:long,score:double,name:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())]))


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([scan(t.as_py()) for t in texts], _TYPE)


def _redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([redacted(t.as_py()) for t in texts], pa.string())


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, secrets``: spans (kind, start and end in code points, score, name) of every whole
    text.  A null or empty text has none; repeated rows and null ids are returned as
    they are; an empty table gives no rows; other columns are ignored."""
    return docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(_scan, SPANS)(F.col(text_col)).alias("secrets"))


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same documents with each secret replaced by a mark, and their length anew."""
    out = docs.withColumn(text_col, F.arrow_udf(_redact, "string")(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
