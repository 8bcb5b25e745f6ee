"""Globs as tokens, translated on the driver to one anchored regular expression (FLT-1)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_tokens(pattern: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each part. '*' and '?' cross '/'; '**' stands for whole components.

    Kinds: char, any, star, class (text: the set of a regular expression), above ('**/': nothing, or whole components),
    below ('/**' at the end), and open, or, close of alternatives.
    """
    k, groups = 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            yield "above", ""
            k += 3
            continue
        if pattern.startswith("/**", k) and k + 3 == len(pattern):
            yield "below", ""
            break
        if c == "*":
            while pattern.startswith("**", k):
                k += 1
            yield "star", ""
        elif c == "?":
            yield "any", ""
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                raise ValueError(f"unclosed character class in {pattern!r}")
            body = pattern[k + 1 : end]
            negated = body[:1] in "!^"
            yield "class", "[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]"
            k = end
        elif c == "{":
            groups += 1
            yield "open", ""
        elif c == "}" and groups:
            groups -= 1
            yield "close", ""
        elif c == "," and groups:
            yield "or", ""
        else:
            if c == "\\" and k + 1 < len(pattern):
                k += 1
            yield "char", pattern[k]
        k += 1
    if groups:
        raise ValueError(f"unclosed alternatives in {pattern!r}")


_AS_REGEX = {"above": "(?:.*/)?", "below": "/.*", "star": ".*", "any": ".", "open": "(?:", "or": "|", "close": ")"}


def glob_regex(pattern: str) -> str:
    """The pattern's own expression, unanchored."""
    return "".join(re.escape(text) if kind == "char" else text or _AS_REGEX[kind] for kind, text in glob_tokens(pattern))


def nests(pattern: str) -> bool:
    """Without '**' a pattern also matches nested, and everything beneath a match."""
    return "**" not in pattern


def anchored(pattern: str) -> str:
    """An expression of the whole path, for names with line ends too."""
    own = glob_regex(pattern)
    return rf"(?s)^(?:.*/)?{own}(?:/.*)?(?!.)" if nests(pattern) else rf"(?s)^{own}(?!.)"


def glob_match(path: Column | str, pattern: str) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(anchored(pattern))
