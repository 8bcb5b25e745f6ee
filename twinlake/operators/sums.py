"""Checksums of blocks: the weak one of every window at once, and the strong one."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 1 << 16


def window_sums(part: bytes, size: int) -> np.ndarray:
    """The weak checksums of all windows of `size` bytes: a = sum of bytes, b = sum of (size - k) * byte k, both modulo 2^16."""
    v = np.frombuffer(part, np.uint8).astype(np.int64)
    at = np.arange(len(v) - size + 1, dtype=np.int64)
    s, j = (np.concatenate([[0], np.cumsum(x)]) for x in (v, v * np.arange(len(v))))
    a, j = s[size:] - s[: len(at)], j[size:] - j[: len(at)]
    return a % _BASE + ((at + size) * a - j) % _BASE * _BASE


def strong_of(part: bytes) -> str:
    """strong_hash() of one value."""
    return hashlib.sha256(part).hexdigest()[:32]
