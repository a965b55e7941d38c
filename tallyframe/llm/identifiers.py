"""Personal data in texts, also where it is disguised: e-mail, IP, card and phone numbers with their places.

Identifiers are found twice: in the text as it is, and in the text as a chain of transducers leaves it.
Every transducer rewrites some stretches and keeps, for each character it gives out, the stretch of the
source it came from:

    homoglyphs  characters that stand for an ASCII one (full width, mathematical, other scripts' digits,
                letters of the same look, all kinds of dashes and spaces); invisible ones go
    signs       ``(at)``, ``[dot]``, ``[.]`` and the like, and the bare words where an address is around them
    digits      spelled digits, four or more in a row, ``plus`` before them and ``dot`` between them

A find in the rewritten text counts if a rewritten character is in it and it holds whole whatever of its
kind it overlaps in the plain text; its span is mapped back to the source. What is found in the plain text
always stays.

Defined cases: a null or empty text has no spans; repeated rows are searched each; all other columns
pass through; an empty table gives an empty result. Places are code points, the end exclusive. A text is
read in time proportional to its length, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

KINDS = ("email", "ip", "card", "phone")

#: What a disguise may say, in lower case.
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "point", "punto")
DIGIT_WORDS = {
    0: ("zero", "oh", "null", "zéro", "cero"), 1: ("one", "eins", "un", "uno"), 2: ("two", "zwei", "zwo", "deux", "dos"),
    3: ("three", "drei", "trois", "tres"), 4: ("four", "vier", "quatre", "cuatro"), 5: ("five", "fünf", "cinq", "cinco"),
    6: ("six", "sechs", "seis"), 7: ("seven", "sieben", "sept", "siete"), 8: ("eight", "acht", "huit", "ocho"), 9: ("nine", "neun", "neuf", "nueve"),
}
#: Last labels of an address that is written in bare words only.
TOP_LABELS = frozenset("com org net edu gov mil int info biz io co me ai app dev eu uk us ca au nz de fr es it nl be ch at pl pt se no fi dk ie mx br in".split())
#: Longest part of such an address before its at.
LOCAL = 64

#: Letters of other scripts that look like an ASCII one.
LIKE = dict(
    zip("аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅ", "aeopcyxijshdqwvABEKMHOPCTYXIJS")
) | dict(zip("ονρικαυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpikauABEZHIKMNOPTYX")) | dict.fromkeys("‐‑‒–—―−", "-") | {"。": "."}
INVISIBLE = "­​‌‍‎‏⁠﻿"


# -- identifiers in a text ----------------------------------------------------------------------------

_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of local@domain one after the other, found from their ats."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        else:
            free = at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        parts = [x.lstrip("0") for x in match[0].split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            yield match.span()


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return sum(values[::2] + [2 * x - 9 * (x > 4) for x in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if 14 <= match.end() - match.start() <= 37:  # 19 digits and 18 signs between
            digits = _digits(match[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 10 <= len(_digits(match[0])) <= 15:
            yield match.span()


def found(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every identifier, kinds as places in KINDS."""
    rows = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, find in ((1, ips), (2, cards), (3, phones)):
            rows += [(a, kind, b) for a, b in find(text)]
    return sorted(rows)


# -- transducers --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Source:
    """A rewritten text: where in the source each character begins and ends, and whether it, or what parts it
    from the one before it, was rewritten."""

    text: str
    begin: np.ndarray
    end: np.ndarray
    new: np.ndarray

    @classmethod
    def of(cls, text: str) -> Source:
        place = np.arange(len(text) + 1)
        return cls(text, place[:-1], place[1:], np.zeros(len(text), bool))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Source:
        """With the stretches (start, end, instead), in order and apart. Each new character stands for the whole stretch."""
        text, begin, end, new, at = [], [], [], [], 0
        for a, b, instead in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], instead]
            fill = len(instead)
            begin += [self.begin[at:a], np.full(fill, self.begin[a] if fill else 0)]
            end += [self.end[at:a], np.full(fill, self.end[b - 1] if fill else 0)]
            new += [self.new[at:a], np.ones(fill, bool)]
            at = b
        joint = "".join(text), np.concatenate(begin), np.concatenate(end), np.concatenate(new)
        joint[3][1:] |= joint[1][1:] > joint[2][:-1]  # what stood before the character is gone
        return Source(*joint)


@cache
def _look_alikes() -> tuple[re.Pattern, dict[str, str]]:
    """Characters beyond Latin that stand for an ASCII one, by Unicode's own rules and LIKE."""
    table = dict.fromkeys(INVISIBLE, "") | LIKE | {" ": " "}
    for code in [*range(0x250, 0xD800), *range(0xE000, 0x20000)]:
        sign = chr(code)
        if sign in table:
            continue
        digit = unicodedata.decimal(sign, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", sign)
        if len(plain) == 1 and " " <= plain <= "~":
            table[sign] = plain
    return re.compile("[" + "".join(map(re.escape, table)) + "]"), table


_WIDE = re.compile("[ ­ɐ-\U0010ffff]")


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not _WIDE.search(text):
        return []
    signs, table = _look_alikes()
    return [(m.start(), m.end(), table[m[0]]) for m in signs.finditer(text)]


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_OPEN, _CLOSE = r"[(\[{<][ \t]{0,3}", r"[ \t]{0,3}[)\]}>]"
_BRACKETED = re.compile(rf"(?i)[ \t]{{0,3}}{_OPEN}(?:(?P<at>@|{_any(AT_WORDS)})|\.|{_any(DOT_WORDS)}){_CLOSE}[ \t]{{0,3}}")
_BARE_AT = re.compile(rf"(?i)(?<=[a-z0-9._%+-])(?:@|[ \t]{{1,3}}{_any(AT_WORDS)}[ \t]{{1,3}})(?=[a-z0-9])")
_BARE_DOT = re.compile(rf"(?i)[ \t]{{1,3}}{_any(DOT_WORDS)}[ \t]{{1,3}}")
_LABELS = re.compile(rf"(?i)[a-z0-9-]{{1,63}}+(?:(?:\.|[ \t]{{1,3}}{_any(DOT_WORDS)}[ \t]{{1,3}})(?=[a-z0-9])[a-z0-9-]{{1,63}}+)++")
_DOT_BEFORE = re.compile(rf"(?i)[ \t]{{1,3}}{_any(DOT_WORDS)}[ \t]{{1,3}}$")


def brackets(text: str) -> list[tuple[int, int, str]]:
    if not any(x in text for x in "([{<"):
        return []
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]


def _local(text: str, at: int, free: int) -> int:
    """Where the part of an address before its at begins."""
    start = at
    while start > max(free, at - LOCAL) and text[start - 1] in _LOCAL_SIGNS:
        start -= 1
    return start


def bare_signs(source: Source) -> list[tuple[int, int, str]]:
    """Bare words for the signs of an address whose last label is a usual one. A bare at needs a disguised dot."""
    text, edits, free = source.text, [], 0
    if not _BARE_DOT.search(text) and not source.new.any():
        return edits
    for match in _BARE_AT.finditer(text):
        a, b = match.span()
        domain = _LABELS.match(text, b) if a >= free else None
        if not domain:
            continue
        dots = [(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text, b, domain.end())]
        bare = match[0] != "@"
        if not dots and not (bare and source.new[b : domain.end()].any()):
            continue
        if re.split(r"[. \t]", domain[0])[-1].lower() not in TOP_LABELS:
            continue
        before, start = [], _local(text, a, free)
        while start < a and bare and (dot := _DOT_BEFORE.search(text, max(free, start - 16), start)):
            further = _local(text, dot.start(), free)
            if further == dot.start():
                break
            before.append((*dot.span(), "."))
            start = further
        if start < a:
            edits += [*reversed(before), *([(a, b, "@")] if bare else []), *dots]
            free = domain.end()
    return edits


_VALUES = {word: str(digit) for digit, words in DIGIT_WORDS.items() for word in words}
_NUMBER = rf"(?:\b{_any(_VALUES)}\b|[0-9]{{1,19}}+)"
_BETWEEN = rf"(?:[ \t]{{0,3}}[-.,][ \t]{{0,3}}|[ \t]{{1,3}}(?:{_any(DOT_WORDS)}[ \t]{{1,3}})?)"
_SPELLED = re.compile(rf"(?i)(?<![\w])(?:(?P<plus>plus)[ \t]{{1,3}}(?={_NUMBER}))?{_NUMBER}(?:{_BETWEEN}{_NUMBER}){{3,}}+")
_TOKEN = re.compile(rf"(?i){_NUMBER}")
_FIRST = re.compile(rf"(?i)\b{_any(_VALUES)}\b")


def digits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits in rows of four or more numbers: blanks and signs between two of them go, a dot stays one."""
    if not _FIRST.search(text):
        return []
    edits = []
    for row in _SPELLED.finditer(text):
        tokens = list(_TOKEN.finditer(text, row.start(), row.end()))
        if sum(x[0].lower() in _VALUES for x in tokens) < 3:
            continue
        if row["plus"]:
            edits.append((row.start(), tokens[0].start(), "+"))
        for one, two in zip(tokens, [*tokens[1:], None]):
            spelled = _VALUES.get(one[0].lower())
            if spelled:
                edits.append((*one.span(), spelled))
            if two and (spelled or two[0].lower() in _VALUES):
                between = text[one.end() : two.start()]
                dot = "." in between or any(x.isalpha() for x in between)
                edits.append((one.end(), two.start(), "." if dot else ""))
    return edits


def normalised(text: str) -> Source | None:
    """The text behind all transducers; None where they change nothing."""
    source = None
    for edit in (homoglyphs, brackets):
        if edits := edit(source.text if source else text):
            source = (source or Source.of(text)).rewritten(edits)
    if source or _BARE_DOT.search(text):
        source = source or Source.of(text)
        if edits := bare_signs(source):
            source = source.rewritten(edits)
    if edits := digits(source.text if source else text):
        source = (source or Source.of(text)).rewritten(edits)
    return source if source is not None and source.new.any() else None


def spans(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind, end, disguised, plain form) of every identifier of a text, by start and kind."""
    base = found(text)
    rows = [(a, kind, b, False, text[a:b]) for a, kind, b in base]
    source = normalised(text)
    if source is not None:
        held = [([a for a, k, _ in base if k == kind], [b for _, k, b in base if k == kind]) for kind in range(len(KINDS))]
        for a, kind, b in found(source.text):
            if source.new[a:b].any():
                start, end = int(source.begin[a]), int(source.end[b - 1])
                begins, ends = held[kind]
                over = range(bisect_right(ends, start), bisect_left(begins, end))
                if all(start <= begins[k] and ends[k] <= end and (begins[k], ends[k]) != (start, end) for k in over):
                    rows.append((start, kind, end, True, source.text[a:b]))
    return sorted(rows)


# -- tables -------------------------------------------------------------------------------------------

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("disguised", T.BooleanType(), False),
        T.StructField("plain", T.StringType(), False),
    ]
)
_ARROW = [pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False), pa.field("disguised", pa.bool_(), False), pa.field("plain", pa.string(), False)]


def identified(docs: DataFrame, text: str = "text", out: str = "identifiers") -> DataFrame:
    """Append the identifiers of every whole text, by start and kind; ``disguised`` ones were found only behind
    the transducers, and ``plain`` is how an identifier reads there."""
    schema = c.schema_with(docs, (out, T.ArrayType(SPAN, False)))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        each = [spans(x) for x in c.as_texts(c.column(batch, text))]
        rows = [x for own in each for x in own]
        start, kind, end, disguised, plain = map(list, zip(*rows)) if rows else ([], [], [], [], [])
        columns = [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(disguised, pa.bool_()), pa.array(plain, pa.string())]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=_ARROW))]

    return c.passing(docs, text, schema, work)


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
