"""Vectorised words, word hashes and word shingles over Arrow string batches.

A word is a maximal run of bytes other than space and TAB..CR (all separators
are single ASCII bytes, so working on UTF-8 bytes is exact). ``A-Z`` are folded
to lower case, nothing else. Texts are never cut: a text longer than a segment
is hashed in segments that end between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SEGMENT_BYTES = 1 << 19
SLICE_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 2**63, size=SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; consumes its argument."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = [_powers(_BASE, SEGMENT_BYTES + 1), _powers(_BASE_INV, SEGMENT_BYTES + 1)]


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets into them; null is empty."""
    if strings.null_count:
        strings = strings.fill_null("")
    wide = pa.types.is_large_string(strings.type)
    if not (wide or pa.types.is_string(strings.type)):
        strings, wide = strings.cast(pa.large_string()), True
    kind = np.int64 if wide else np.int32
    _, where, data = strings.buffers()
    offsets = np.frombuffer(where, dtype=kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _segments(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = min(end, lo + SEGMENT_BYTES)
        if hi < end:
            k = int(np.searchsorted(at, hi, side="right")) - 1
            if at[k] > lo:
                hi = int(at[k])
            else:
                gaps = np.flatnonzero(_SEPARATOR[raw[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:
                    stop = int(at[k + 1])
                    while hi < stop and not _SEPARATOR[raw[hi]]:
                        hi += 1
        yield lo, hi
        lo = hi


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, its first byte's position, and n + 1 word offsets of the texts."""
    hashes, starts = [], []
    for lo, hi in _segments(raw, at):
        data = raw[lo:hi]
        inside = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        cut = at[(at > lo) & (at < hi)] - lo
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])
        marks = np.flatnonzero(edge)
        if len(cut):
            marks = np.sort(np.concatenate([marks, cut, cut]))
        s, e = marks[0::2], marks[1::2]
        n = len(data)
        up, down = _POWERS if n <= SEGMENT_BYTES else (_powers(_BASE, n + 1), _powers(_BASE_INV, n + 1))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h ^= (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append(mix(h))
        starts.append(s + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.searchsorted(start, at, side="left")


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of fewer than SHINGLE_WORDS words taken as one shingle."""
    h = np.full(1, len(words), dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    h += (words * _PLACE[: len(words)]).sum(dtype=np.uint64)
    return mix(h)[0]


def all_shingles(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The shingle hashes of each text in order of position, repeats included."""
    n = len(words) - SHINGLE_WORDS + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        rolled += words[k : k + len(rolled)] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= SHINGLE_WORDS:
            out.append(rolled[lo : hi - SHINGLE_WORDS + 1])
        elif hi > lo:
            out.append(np.array([sequence_hash(words[lo:hi])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def shingle_sets(strings: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, at = buffers(strings)
    words, _, bounds = word_hashes(raw, at)
    return [np.unique(x) for x in all_shingles(words, bounds)]


def digest(values: np.ndarray) -> bytes:
    """A 128-bit name of a sorted set of hashes."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
