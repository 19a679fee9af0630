"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as one symbol for each byte, the last with the end-of-word mark.
The adjacent pair of lowest rank is merged again and again, leftmost first on
equal ranks: a heap gives the next pair, a linked list its neighbours. The
count is the initial symbols less the merges; no identifiers are made.

Merging never crosses white space, so counts are remembered by white-space
delimited chunk in a table of bounded size; a miss only costs time.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textvec

TOKEN_LIMIT = 2048
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64

_SPACE = regex.compile(r"\p{White_Space}+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


def load_merges(path: str) -> dict:
    """What counting needs of a vocabulary file: initial symbols, pair ranks and special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
    number: dict[str, int] = {}
    of = lambda s: number.setdefault(s, len(number))
    chars = byte_characters()
    inner, final = [of(c) for c in chars], [of(c + suffix) for c in chars]
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        pairs.setdefault((of(left), of(right)), (rank, of(left + right)))
    return {"inner": inner, "final": final, "pairs": pairs, "special": [t["content"] for t in spec["added_tokens"]]}


class Counter:
    def __init__(self, spec: dict):
        self.inner, self.final, self.pairs = spec["inner"], spec["final"], spec["pairs"]
        special = sorted(spec["special"], key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.hints = {s[:2] for s in special}
        self.chunks: dict[str, int] = {}

    def merge_count(self, data: bytes) -> int:
        """Tokens of one piece."""
        n = len(data)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.final[data[-1]]
        pairs, after, before = self.pairs, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append(found[0] * n + i)
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or symbol[i] < 0:
                continue
            found = pairs.get((symbol[i], symbol[j]))
            if not found or found[0] != rank:
                continue
            merges += 1
            symbol[i], symbol[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((symbol[i], symbol[k]))
                if found:
                    heapq.heappush(heap, found[0] * n + i)
            h = before[i]
            if h >= 0:
                found = pairs.get((symbol[h], symbol[i]))
                if found:
                    heapq.heappush(heap, found[0] * n + h)
        return n - merges

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk without white space and special strings."""
        if chunk.isascii():
            pieces = _ASCII_PIECES.findall(chunk.lower())
        else:
            pieces = _PIECES.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        n = sum(self.merge_count(p.encode()) for p in pieces)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self.chunks) >= REMEMBERED:
                self.chunks.clear()
            self.chunks[chunk] = n
        return n

    def plain(self, text: str) -> int:
        known, chunk = self.chunks.get, self.chunk
        total = 0
        for c in _SPACE.split(text) if _ODD_SPACE.search(text) else text.split():
            n = known(c)
            total += chunk(c) if n is None else n
        return total

    def count(self, text: str) -> int:
        if self.special and any(h in text for h in self.hints):
            parts = self.special.split(text)
            return sum(self.plain(p) for p in parts[::2]) + len(parts) // 2
        return self.plain(text)


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE .json file on the driver; its
    merges (of the vocabulary's size, whatever the input) go to the executors
    as a broadcast. Null counts as empty: 0 bytes, 0 tokens. Texts are read
    whole. Equal rows get equal counts; an empty table gives an empty result.
    """
    spec, name = docs.sparkSession.sparkContext.broadcast(load_merges(vocabulary)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(name)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[name] = Counter(spec.value)
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                _, at = textvec.buffers(part.column(1))
                tokens = np.array([counter.count(t) if t else 0 for t in part.column(1).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(tokens), pa.array(tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
