"""Hashed character n-grams of whole texts as numpy arrays."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

SEGMENT = 1 << 18
MOST = 12
_MUL = np.random.default_rng(12).integers(1, 2**63, size=MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter(
            (unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1
        )
    return _TABLES["letters"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def letter_stream(text: str) -> np.ndarray:
    """Lower-case letters of a text with one blank (0) for each run of others, and one at either end."""
    points = code_points(text.lower())
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, points, 0)[keep]
    pad = np.zeros(1, dtype=out.dtype)
    return np.concatenate([pad, out, pad]) if len(out) == 0 or out[-1] else np.concatenate([pad, out])


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram of the code points, in ``bits`` bits."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    wide = points.astype(np.uint64)
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h += wide[k : k + m] * _MUL[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def segments(points: np.ndarray, n: int):
    """The points in parts of bounded length that share n - 1 with the next, so that no n-gram is lost or doubled."""
    lo = 0
    while True:
        yield points[lo : lo + SEGMENT + n - 1]
        lo += SEGMENT
        if lo + n - 1 >= len(points):
            return
