"""Ranked lexical search by block-max pruning.

Documents are kept in ranges of RANGE by id. A block holds, for one range, the
postings of the terms that the items ask for, and for each term the largest
gain of any of its documents. The bound of an item on a block is the sum of
weight times largest gain over its terms. Each task takes its blocks in batches,
sorts a batch by bound for each item, and scores blocks in that order until the
bound is below the item's tenth best score so far; a block of equal bound is
still scored, as it may hold an earlier id. The best of all tasks are merged.

Three passes: terms are counted once in whole texts, and only the counts of
asked terms are written; totals and document frequencies are sums over those;
then the blocks are built and searched. Items go in waves of ITEM_BYTES of
text, which bounds the vocabulary that is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec
from .shared import Workspace

TOP = 10
RANGE = 64
LENGTH_PERCENT = 90
SCALE = 1_000_000_000
ITEM_BYTES = 4 << 20
SEGMENT = 1 << 20
NO_ID = np.iinfo(np.int64).max

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in parts of bounded size that end between terms."""
    lo = 0
    while lo < len(data):
        hi = lo + SEGMENT
        part = data[lo:hi].translate(_FOLD)
        while hi < len(data) and part[-1] != 0x20:
            more = data[hi : hi + SEGMENT].translate(_FOLD)
            stop = more.find(b" ")
            part += more if stop < 0 else more[: stop + 1]
            hi += len(more) if stop < 0 else stop + 1
        yield part.split()
        lo = hi


def count_terms(data: bytes, vocabulary: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """All terms of a text with repeats, and the occurrences of those in the vocabulary."""
    total, found = 0, {}
    for words in terms_of(data):
        total += len(words)
        counts = Counter(words)
        for w in vocabulary.keys() & counts.keys():
            k = vocabulary[w]
            found[k] = found.get(k, 0) + counts[w]
    return total, found


class Items:
    """A wave of items: ids, vocabulary, and each item's terms as ascending term numbers."""

    def __init__(self, first: int, ids: list, texts: list[str]):
        self.first, self.ids, self.vocabulary = first, ids, {}
        self.terms = [
            np.array(sorted({self.vocabulary.setdefault(w, len(self.vocabulary)) for words in terms_of(t.encode()) for w in words}), dtype=np.int64)
            for t in texts
        ]


def waves(items: DataFrame, id_col: str, text_col: str, limit: int = ITEM_BYTES) -> Iterator[Items]:
    ids, texts, size, first = [], [], 0, 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").orderBy("i", "t").toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += len(row.t.encode())
        if size >= limit:
            yield Items(first, ids, texts)
            first, ids, texts, size = first + len(ids), [], [], 0
    if ids:
        yield Items(first, ids, texts)


def _counted(docs: DataFrame, sent) -> DataFrame:
    """doc_id, n, terms, counts of each document; terms are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for part in textvec.slices(batch, "text"):
                raw, at = textvec.buffers(part.column(1))
                sizes, terms, counts = [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                    n, found = count_terms(raw[lo:hi].tobytes(), vocabulary)
                    sizes.append(n)
                    terms.append(list(found))
                    counts.append(list(found.values()))
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, k) for v, k in zip((sizes, terms, counts), kinds))], names=["doc_id", "n", "terms", "counts"]
                )

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of each list."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _blocks(counted: DataFrame, n_docs: int, n_terms: int, size: int) -> DataFrame:
    """One row for each range of ``size`` documents: ids, its terms ascending with their largest gains, and postings by term."""
    schema = "docs array<long>, terms array<int>, most array<long>, stops array<int>, places array<int>, gains array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            long = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * batch.column(1).to_numpy(zero_copy_only=False) * n_docs) // n_terms
            terms, lengths = _flat(batch.column(2))
            counts, _ = _flat(batch.column(3))
            doc = np.repeat(np.arange(len(ids)), lengths)
            gains = (SCALE * counts) // (1000 * counts + 8 * long[doc])
            order = np.lexsort((doc, terms, doc // size))
            terms, doc, gains = terms[order], doc[order], gains[order]
            edges = np.searchsorted(doc // size, np.arange(-(-len(ids) // size) + 1))
            rows = []
            for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                own, starts = np.unique(terms[lo:hi], return_index=True)
                most = np.maximum.reduceat(gains[lo:hi], starts) if len(own) else gains[lo:hi]
                rows.append((ids[k * size : (k + 1) * size], own, most, np.append(starts[1:], hi - lo)[: len(own)], doc[lo:hi] - k * size, gains[lo:hi]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.list_(kinds[c])) for c in range(6)], names=["docs", "terms", "most", "stops", "places", "gains"]
            )

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, schema)


class Search:
    """The best documents of each item of a wave, kept while blocks go by."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray, top: int):
        self.terms, self.weights, self.top = terms, weights, top
        every = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])[np.argsort(every, kind="stable")]
        self.starts = np.searchsorted(np.sort(every), np.arange(len(weights) + 1))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in terms]
        self.least = np.ones(len(terms), dtype=np.int64)
        self.scored = 0

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each item the most that a document of the block can score."""
        n = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        out = np.zeros(len(self.terms), dtype=np.int64)
        np.add.at(out, self.owner[at], np.repeat(self.weights[terms] * most, n))
        return out

    def score(self, item: int, block: tuple) -> None:
        ids, terms, _, stops, places, gains = block
        asked = self.terms[item]
        at = np.searchsorted(terms, asked)
        at[at == len(terms)] = 0
        hit = terms[at] == asked
        at, weight = at[hit], self.weights[asked[hit]]
        lo = np.where(at > 0, stops[at - 1], 0)
        n = stops[at] - lo
        where = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        scores = np.zeros(len(ids), dtype=np.int64)
        np.add.at(scores, places[where], gains[where] * np.repeat(weight, n))
        self.scored += 1
        new = np.flatnonzero(scores >= self.least[item])
        if len(new):
            docs, values = (np.concatenate(x) for x in zip(self.best[item], (ids[new], scores[new])))
            order = np.lexsort((docs, -values))[: self.top]
            self.best[item] = docs[order], values[order]
            if len(order) == self.top:
                self.least[item] = values[order[-1]]

    def take(self, blocks: list[tuple]) -> None:
        """For each item, the blocks in order of bound, until it is below the least score that still counts."""
        blocks = [b for b in blocks if len(b[1])]
        if not blocks:
            return
        bounds = np.stack([self.bounds(b[1], b[2]) for b in blocks])
        order = np.argsort(-bounds, axis=0, kind="stable")
        for item in np.flatnonzero(bounds.max(axis=0) >= self.least).tolist():
            for k in order[:, item].tolist():
                if bounds[k, item] < self.least[item]:
                    break
                self.score(item, blocks[k])


def _searched(blocks: DataFrame, sent, schema: str, item_type: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, top = sent.value
        search = Search(items.terms, weights, top)
        for batch in batches:
            columns = [_flat(batch.column(c)) for c in range(6)]
            edges = [np.append(0, np.cumsum(n)) for _, n in columns]
            search.take([tuple(v[e[k] : e[k + 1]] for (v, _), e in zip(columns, edges)) for k in range(len(batch))])
        which = np.repeat(np.arange(len(items.ids)), [len(d) for d, _ in search.best])
        docs, scores = (np.concatenate([b[c] for b in search.best]) if search.best else np.zeros(0, np.int64) for c in range(2))
        yield pa.RecordBatch.from_arrays(
            [pa.array(which + items.first), pa.array([items.ids[i] for i in which.tolist()], item_type), pa.array(docs, mask=docs == NO_ID), pa.array(scores)],
            names=["turn", "item_id", "doc_id", "score"],
        )

    return blocks.mapInArrow(run, schema)


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    size: int = RANGE,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, ranked from 1; equal scores by id.

    Ids of documents are whole numbers; a null id comes last among equal scores
    (the largest long stands for it). Rows that repeat an id are documents of
    their own, items that repeat an id are ranked each for itself under it.
    Null, empty and term-less texts and items match nothing. Texts are read
    whole. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "search")
    kind = items.schema[item_col].dataType
    schema = f"turn long, item_id {kind.simpleString()}, doc_id long, score long"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for wave in waves(items, item_col, item_text_col, item_bytes):
        counted = space.keep(_counted(slim, spark.sparkContext.broadcast(wave.vocabulary)), "counted")
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_terms or not wave.vocabulary:
            continue
        weights = np.zeros(len(wave.vocabulary), dtype=np.int64)
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
        ranged = counted.where("n > 0").repartitionByRange("doc_id", F.xxhash64("n", "terms", "counts")).sortWithinPartitions("doc_id")
        blocks = space.keep(_blocks(ranged, n_docs, n_terms, size), "blocks")
        best = _searched(blocks, spark.sparkContext.broadcast((wave, weights, top)), schema, to_arrow_type(kind))
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("turn").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = space.keep(found, "found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
