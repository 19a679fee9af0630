"""Benchmark decontamination: SimHash of item-sized windows, joined by multi-index Hamming blocks.

A benchmark item's fingerprint is the SimHash, BITS wide, of its weighted
shingles (a shingle's weight is how often it occurs). A document is read in
windows of an item's number of words, at every position; a window's fingerprint
comes from running sums over the document's shingles. Fingerprints within
RADIUS bits agree in one of BLOCKS blocks of 16 bits but for ERRORS bits
(pigeonhole), so the blocks of the items, with those bits changed in every way,
give all items within the radius of a window. An unrelated item is met by a
window with a chance of 16 %. The distance is then exact, and all windows
within the radius are verified by the weighted Jaccard similarity of their
shingles, at least SIMILARITY. Bits of a pair at that similarity differ with a
chance of 0.172 (the angle of a cosine of 6/7), 44 of BITS on average with a
deviation of 6, so a pair lies within the radius with a chance above 0.999.

A window that shares no shingle with any item has similarity 0, which no radius
changes; a lookup of the items' shingles passes such windows over before the
fingerprints. That is exact, and all that the lookup does.

The items are the small side by nature, and that is checked: they are packed
into tables of at most ITEMS_AT_ONCE items (some 45 KB each), one broadcast
each, and the documents are read once for each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec

BITS = 256
BLOCKS = BITS // 16
ERRORS = 3
RADIUS = BLOCKS * (ERRORS + 1) - 1
SIMILARITY = 0.75
ITEMS_AT_ONCE = 2_000
WINDOWS_AT_ONCE = 1 << 12

#: All ways to change at most ERRORS of 16 bits.
_FLIPS = np.array([sum(1 << b for b in bits) for e in range(ERRORS + 1) for bits in combinations(range(16), e)], dtype=np.uint16)
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    words = [textvec.mix(shingles * _SECOND + np.uint64(k)) for k in range(BITS // 64)]
    words = np.stack(words, axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a text's shingles, repeats counted, as BITS / 8 bytes."""
    return _pack(_signs(shingles).sum(axis=0, keepdims=True))[0]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater counts of two shingle sequences."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least / max(1, len(a) + len(b) - least)


class Items:
    """Fingerprints, block table and shingles of benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        raw, at = textvec.buffers(pa.array(texts, pa.string()))
        words, _, bounds = textvec.word_hashes(raw, at)
        shingles = textvec.all_shingles(words, bounds)
        kept = [k for k, s in enumerate(shingles) if len(s)]
        self.ids = [ids[k] for k in kept]
        self.words = np.diff(bounds)[kept]
        self.shingles = [shingles[k].copy() for k in kept]
        self.prints = np.stack([fingerprint(s) for s in self.shingles]) if kept else np.zeros((0, BITS // 8), np.uint8)
        owner = np.repeat(np.arange(len(kept)), [len(s) for s in self.shingles])
        flat = np.concatenate(self.shingles) if kept else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS)
        self.begin, self.met = [], []  # of each block value: where its items stand in the block's list
        for k in range(BLOCKS):
            values = (blocks[:, k : k + 1] ^ _FLIPS).ravel()
            order = np.argsort(values, kind="stable")
            self.begin.append(np.searchsorted(values[order], np.arange((1 << 16) + 1)).astype(np.int32))
            self.met.append((order // len(_FLIPS)).astype(np.int32))

    def met_by(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) for each block in which the two agree but for ERRORS bits; pairs may repeat."""
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        rows, items = [], []
        for k in range(BLOCKS):
            lo, hi = self.begin[k][blocks[:, k]], self.begin[k][blocks[:, k].astype(np.int64) + 1]
            n = (hi - lo).astype(np.int64)
            rows.append(np.repeat(np.arange(len(blocks)), n))
            at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            items.append(self.met[k][at])
        return np.concatenate(rows), np.concatenate(items)

    def near(self, prints: np.ndarray, able: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) for all pairs within RADIUS, by way of the blocks; ``able`` marks the items asked for."""
        found = []
        wide, own = np.ascontiguousarray(prints).view(np.uint64), self.prints.view(np.uint64)
        for lo in range(0, len(prints), WINDOWS_AT_ONCE):
            row, item = self.met_by(prints[lo : lo + WINDOWS_AT_ONCE])
            if able is not None:
                row, item = row[able[item]], item[able[item]]
            pair = np.unique((row + lo) * len(own) + item)
            row, item = np.divmod(pair, max(1, len(own)))
            far = np.bitwise_count(wide[row] ^ own[item]).sum(axis=1)
            found.append(pair[far <= RADIUS])
        return np.divmod(np.concatenate([np.zeros(0, np.int64), *found]), max(1, len(own)))

    def matches(self, shingles: np.ndarray, n_words: int) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that a document holds."""
        if not len(self.flat) or not len(shingles):
            return []
        place = np.searchsorted(self.flat, shingles)
        place[place == len(self.flat)] = 0
        hits = np.flatnonzero(self.flat[place] == shingles)
        if not len(hits):
            return []
        starts_for: dict[int, list[tuple[int, int]]] = {}
        for h in hits.tolist():
            lo = int(np.searchsorted(self.flat, shingles[h], side="left"))
            hi = int(np.searchsorted(self.flat, shingles[h], side="right"))
            for length in {int(self.words[o]) for o in self.owner[lo:hi].tolist()}:
                size = min(length, n_words)
                wide = max(1, size - textvec.SHINGLE_WORDS + 1)
                starts_for.setdefault(size, []).append((max(0, h - wide + 1), min(h, len(shingles) - wide)))
        best: dict[int, tuple[float, int, int]] = {}
        for size, ranges in starts_for.items():
            wide = max(1, size - textvec.SHINGLE_WORDS + 1)
            starts = np.unique(np.concatenate([np.arange(lo, hi + 1) for lo, hi in ranges]))
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > wide) + 1):
                lo = int(group[0])
                signs = _signs(shingles[lo : int(group[-1]) + wide])
                sums = np.zeros((len(signs) + 1, BITS), dtype=np.int32)
                np.cumsum(signs, axis=0, out=sums[1:])
                prints = _pack(sums[group - lo + wide] - sums[group - lo])
                for at, item in zip(*(x.tolist() for x in self.near(prints, np.minimum(self.words, n_words) == size))):
                    start = int(group[at])
                    similarity = weighted_jaccard(shingles[start : start + wide], self.shingles[item])
                    if similarity >= SIMILARITY and (item not in best or (-similarity, start) < (-best[item][0], best[item][1])):
                        best[item] = (similarity, start, size)
        return [(item, *found) for item, found in sorted(best.items())]


def _tables(benchmark: DataFrame, at_once: int) -> Iterator[Items]:
    rows = benchmark.where("text is not null").select("item_id", "text").dropDuplicates().orderBy("item_id", "text")
    ids, texts = [], []
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        if len(ids) == at_once:
            yield Items(ids, texts)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document for each item it holds.

    Documents without a window of similarity SIMILARITY or more give no row. A
    text shorter than an item is one window; fewer than five words are one
    shingle. Of equally similar windows the first counts. Null and blank texts
    and items match nothing. Repeated rows give repeated results; items that
    repeat an id with other texts are items of their own. Ids may be of any
    type and null. Both tables may be empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long"
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _tables(benchmark, items_at_once):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textvec.slices(batch, "text"):
                    raw, at = textvec.buffers(part.column(1))
                    words, _, bounds = textvec.word_hashes(raw, at)
                    rows, found = [], []
                    for k, shingles in enumerate(textvec.all_shingles(words, bounds)):
                        for match in sent.value.matches(shingles, int(bounds[k + 1] - bounds[k])):
                            rows.append(k)
                            found.append(match)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(rows, pa.int64())),
                            pa.array([sent.value.ids[m[0]] for m in found], item_type),
                            pa.array([m[1] for m in found], pa.float64()),
                            pa.array([m[2] for m in found], pa.int64()),
                            pa.array([m[3] for m in found], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

        rows = slim.mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns as they were. Rows with a null id are kept."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
