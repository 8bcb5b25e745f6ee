"""SHA-256 that one process can take up where another has left it (SRC-1)."""

from __future__ import annotations

import ctypes
import struct

#: OpenSSL's SHA256_CTX: state, bits (low word, high word), the block begun, its bytes, and bytes of the digest.
_CONTEXT = struct.Struct("=8I2I64s2I")


class Sha256:
    """The hash of what comes after `done` bytes, from the state of 32 bytes after these.

    hashlib keeps its state to itself, so this calls the library below it.
    """

    def __init__(self, state: bytes = b"", done: int = 0):
        if done % 64:
            raise ValueError(f"a state is known after whole blocks of 64 bytes, not after {done}")
        import _hashlib  # a Python built without OpenSSL has none

        self._lib = ctypes.CDLL(_hashlib.__file__)
        self._context = ctypes.create_string_buffer(_CONTEXT.size)
        self._lib.SHA256_Init(self._context)
        if done:
            bits = done * 8
            _CONTEXT.pack_into(self._context, 0, *struct.unpack(">8I", state), bits & 0xFFFFFFFF, bits >> 32, b"", 0, 32)

    def update(self, part: bytes) -> None:
        self._lib.SHA256_Update(self._context, part, ctypes.c_size_t(len(part)))

    def state(self) -> bytes:
        """Known after whole blocks of 64 bytes only."""
        *values, begun, _ = _CONTEXT.unpack(self._context.raw)
        if begun:
            raise ValueError("within a block of 64 bytes there is no state")
        return struct.pack(">8I", *values[:8])

    def digest(self) -> bytes:
        """The hash; nothing can be added after it."""
        found = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(found, self._context)
        return found.raw
