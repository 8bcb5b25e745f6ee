"""Operator 4: personal data in whole texts, also where it is disguised, with spans in the source text.

Base spans are e-mail addresses, IP addresses, card and phone numbers as they stand. For disguised ones a text goes
through two transducers: one maps look-alike letters and foreign digits to ASCII, code point by code point; the
other rewrites "at" and "dot" disguises, runs of spelled digits and invisible characters, and notes for each written
character the source characters it came from. Spelled digits are English; fewer than seven are rewritten only around
"dot" or next to digits, and the detectors' length and Luhn tests decide. The same detectors run on the rewritten text,
and a match that holds a rewritten character is mapped back and added, if no base span is the same. Base spans always stay.

Left out for precision: "-at-" before a plain host ("stay-at-home.com" is a host), "at" before "www.", a one-sided "@"
with a blank (handles look alike), and long spelled numbers without "plus", since the same digits, written plainly, are no
phone number either. Spelled digits of other languages are not known.

Defined results: a null text counts as empty: no spans; a plain text costs a few substring searches; spans count
code points, end exclusive; repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored by detect() and kept by redacted().
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST_NAME = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match begins where a run of digits begins: behind a failed start, later ones in its run fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """From each "@" to both sides: no part of the text is looked at twice, however long its runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        host = _HOST_NAME.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans: leftmost non-overlapping matches of each kind; matches that fail the test are dropped."""
    found = []
    if "@" in text:
        found += _emails(text)
    if any(d in text for d in "0123456789"):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := "".join(_DIGITS.findall(m[0]))) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return found


# Letters of other scripts that look like an ASCII letter.
LOOK_ALIKES = {
    "а": "a", "в": "B", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "T", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "․": ".", "﹒": ".", "。": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹢": "+",
}
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_INVISIBLE = "­​‌‍⁠﻿"
_NUMBER = "(?:" + "|".join(SPELLED) + ")"
_GAP = r"[\x20\t,-]{1,3}"
#: At least seven spelled digits (four with "dot" between them, any number next to digits), perhaps behind "plus".
_RUN = rf"(?<![A-Za-z])(?:plus{_GAP})?{_NUMBER}(?:{_GAP}(?:dot{_GAP}|point{_GAP})?{_NUMBER}){{3,}}(?![A-Za-z])"
_SHORT = rf"(?<![A-Za-z])(?:plus{_GAP})?{_NUMBER}(?:{_GAP}{_NUMBER}){{0,2}}(?![A-Za-z])"
#: What may stand between a digit and a spelled one next to it.
_JOINT = rf"(?:[\x20\t,-]{{0,3}}|\.|\)[\x20-]?|[\x20-]?\(|[\x20]dot[\x20]|_dot_)"
_AFTER_DIGIT, _DIGIT_NEXT = re.compile(rf"[0-9]{_JOINT}$", re.IGNORECASE), re.compile(rf"{_JOINT}[0-9]", re.IGNORECASE)
_OPEN, _CLOSE = r"[\x20]*[\[({<][\x20]*", r"[\x20]*[\])}>][\x20]*"
_PLAIN_DOT = r"(?:[\x20]+dot[\x20]+|_dot_|-dot-)(?=[A-Za-z0-9-])"
_DOT = rf"{_OPEN}(?:dot|\.){_CLOSE}"
_DASHED_HOST = r"[A-Za-z0-9]+(?:-dot-[A-Za-z0-9]+)+(?![A-Za-z0-9-])"
#: A host behind a plain "at": with a disguised dot, or with a plain one before a name of at least two letters.
_HOST = rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT}|[\x20]+dot[\x20]+|_dot_)[A-Za-z0-9-]+)*(?:{_DOT}|[\x20]+dot[\x20]+|_dot_)[A-Za-z]"
_PLAIN_HOST = r"(?!www\.)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2}"
_REWRITE = re.compile(
    rf"(?P<none>[{_INVISIBLE}]+)|(?P<run>{_RUN}|{_SHORT})|(?P<at>(?<=[A-Za-z0-9_%+-]){_OPEN}(?:at|@){_CLOSE}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9_%+-])(?:[\x20]+(?:at|@)[\x20]+|_at_)(?={_HOST}|{_PLAIN_HOST})|(?<=[A-Za-z0-9])-at-(?={_DASHED_HOST}))"
    rf"|(?P<dot>(?<=[A-Za-z0-9-])(?:{_DOT}|{_PLAIN_DOT}))",
    re.IGNORECASE,
)
_INSIDE = re.compile(rf"(?P<number>{_NUMBER})|(?P<dot>dot|point)|(?P<plus>plus)", re.IGNORECASE)
_FOREIGN = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + "！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff" + "]")
#: Implied by every branch of _REWRITE that can lead to a span: brackets, dots, plain "at", invisible characters, long runs, digits next to spelled ones.
_DISGUISED = re.compile(
    rf"[\[({{<][\x20]*(?:at|dot|@|\.)[\x20]*[\])}}>]|[\x20_-]dot[\x20_-]|[\x20_](?:at|@)[\x20_]+(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2}}|[{_INVISIBLE}]"
    rf"|{_NUMBER}(?:{_GAP}(?:(?:dot|point){_GAP})?{_NUMBER}){{3}}|[0-9]{_JOINT}(?:plus{_GAP})?{_NUMBER}|{_NUMBER}{_JOINT}[0-9]",
    re.IGNORECASE,
)


def _ascii(c: str) -> str:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.digit(c))


def normalise(text: str) -> tuple[str, list[int], list[int], list[tuple[int, int]]]:
    """The rewritten text; where its pieces start in it and in the source; the rewritten stretches in the source.

    Pieces of equal length map one to one; a shorter piece stands whole for its source stretch.
    """
    changed, even = [], text
    if not text.isascii():
        changed = [m.span() for m in _FOREIGN.finditer(text)]
        if changed:
            even = _FOREIGN.sub(lambda m: _ascii(m[0]), text)
    out, at_out, at_src, size, done = [], [], [], 0, 0

    def put(piece: str, start: int) -> None:
        nonlocal size
        out.append(piece)
        at_out.append(size)
        at_src.append(start)
        size += len(piece)

    for m in _REWRITE.finditer(even):
        if m["run"] and len(re.findall(_NUMBER, m[0], re.IGNORECASE)) < 7 and not re.search("dot|point", m[0], re.IGNORECASE):
            if not (_AFTER_DIGIT.search(even, max(0, m.start() - 6), m.start()) or _DIGIT_NEXT.match(even, m.end())):
                continue
        if m.start() > done:
            put(even[done : m.start()], done)
        if m["run"]:
            for x in _INSIDE.finditer(m[0]):
                put(SPELLED[x[0].lower()] if x["number"] else "." if x["dot"] else "+", m.start() + x.start())
        elif m["at"] or m["dot"]:
            put("@" if m["at"] else ".", m.start())
        changed.append(m.span())
        done = m.end()
    if done < len(even):
        put(even[done:], done)
    at_out.append(size)
    at_src.append(len(even))
    return "".join(out), at_out, at_src, sorted(changed)


def _pieces_end(k: int, at_out: list[int], at_src: list[int], source: str) -> int:
    """Where the source stretch of piece k ends, without blanks or signs that only separate."""
    n = at_out[k + 1] - at_out[k]
    stretch = source[at_src[k] : at_src[k + 1]]
    if n == len(stretch):
        return at_src[k + 1]
    if n > 1:  # an unchanged piece in front of invisible characters
        return at_src[k] + n
    return at_src[k] + len(stretch.rstrip(" \t,-" + _INVISIBLE))


def disguised_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that hold a rewritten character, in source positions."""
    if not (_DISGUISED.search(text) or (not text.isascii() and _FOREIGN.search(text))):
        return []
    clear, at_out, at_src, changed = normalise(text)
    starts, found = [s for s, _ in changed], []
    for kind, a, b in plain_spans(clear):
        i, j = bisect_right(at_out, a) - 1, bisect_right(at_out, b - 1) - 1
        start = at_src[i] + a - at_out[i]
        end = _pieces_end(j, at_out, at_src, text) if b == at_out[j + 1] else at_src[j] + b - at_out[j]
        k = bisect_right(starts, end - 1) - 1
        if k >= 0 and changed[k][1] > start:
            found.append((kind, start, end))
    return found


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; each by start, then kind as listed, then end."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(plain_spans(text or ""), key=order)
    added = disguised_spans(text or "")
    return base, sorted({*base, *added}, key=order) if added else base


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and base and spans: arrays of (kind, start, end); no shuffle."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_dicts = lambda some: [{"kind": k, "start": a, "end": b} for k, a, b in some]

    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [spans(t) for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("key"), pa.array([as_dicts(b) for b, _ in found], span), pa.array([as_dicts(s) for _, s in found], span)], ["key", "base", "spans"])

    array = "array<struct<kind:string,start:long,end:long>>"
    return src.mapInArrow(detected, f"key {src.schema['key'].dataType.simpleString()}, base {array}, spans {array}").withColumnRenamed("key", key)


def redact(text: str | None) -> str | None:
    """The text with each span, or overlapping spans together, replaced by the first one's kind."""
    if text is None or not (found := spans(text)[1]):
        return text
    out, done = [], 0
    groups: list[list] = []
    for kind, a, b in found:
        if groups and a < groups[-1][2]:
            groups[-1][2] = max(b, groups[-1][2])
        else:
            groups.append([kind, a, b])
    for kind, a, b in groups:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with personal data in the text replaced; columns as they are."""
    place = df.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                columns = [*batch.columns]
                columns[place] = pa.array(map(redact, batch.column(place).to_pylist()), batch.schema.field(place).type)
                yield pa.record_batch(columns, batch.schema.names)

    return df.mapInArrow(clean, df.schema)


def digest(listed: str) -> str:
    return hashlib.sha256(listed.encode()).hexdigest()
