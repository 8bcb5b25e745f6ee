"""Column functions on paths, modes and contents (SCL-1 to SCL-4, FLT-5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODE_MASK = 0o7777
SAFE_MASK = 0o1777


def components(path: Column | str) -> Column:
    """The components; arrays of them sort parents before children, unlike plain strings."""
    return F.split(path, "/")


def parent(path: Column | str) -> Column:
    """Everything before the last component; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column | str) -> Column:
    return F.size(F.split(path, "/"))


def under(path: Column | str, prefix: str) -> Column:
    """Whether the path is the prefix or lies below it, by whole components."""
    path = F.col(path) if isinstance(path, str) else path
    return (path == prefix) | path.startswith(prefix + "/")


def unsafe(path: Column | str) -> Column:
    """A '..' component, a leading '/' or a drive prefix."""
    path = F.col(path) if isinstance(path, str) else path
    return F.exists(F.split(path, r"[/\\]"), lambda c: c == "..") | path.rlike(r"^(/|\\|[A-Za-z]:)")


def mode_bits(mode: Column | str) -> Column:
    return (F.col(mode) if isinstance(mode, str) else mode).bitwiseAND(MODE_MASK)


def safe_mode(mode: Column | str) -> Column:
    """Permission bits without set-user-id and set-group-id."""
    return (F.col(mode) if isinstance(mode, str) else mode).bitwiseAND(SAFE_MASK)


def strong_hash(content: Column | str) -> Column:
    """16 bytes of SHA-256 in hex."""
    return F.substring(F.sha2(content, 256), 1, 32)


def block_size_for(length: Column | str) -> Column:
    """The rounded square root, between 700 and 131,072."""
    return F.greatest(F.lit(700), F.least(F.lit(131072), F.round(F.sqrt(length)).cast("int")))
