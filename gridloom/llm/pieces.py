"""Byte-level text helpers for the Arrow functions: long texts in parts, words, and hashes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PART = 1 << 20
_SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def parts(raw: bytes, size: int = PART) -> Iterator[bytes]:
    """raw in parts of about size bytes, cut before an ASCII white-space byte only (never inside a word:
    a word longer than size stays whole)."""
    at, end = 0, len(raw)
    while end - at > size:
        cut = max(raw.rfind(c, at + 1, at + size) for c in _SPACE)
        if cut <= at:
            found = [p for c in _SPACE if (p := raw.find(c, at + size)) >= 0]
            if not found:
                break
            cut = min(found)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64, wraps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
