"""Language identification by nearest centroid.

A text's vector holds the TF-IDF weights of its hashed letter n-grams (one to
three letters, blanks at word ends), scaled to unit length. Each language has
up to CENTROIDS unit centroids, found by spherical k-means from its training
vectors; a text gets the language of the centroid of greatest cosine.

Short texts have low cosines even in their own language: for d distinct
n-grams, d * (1 / cosine^2 - 1) hardly depends on d, and is far greater for
texts of other languages and for shuffled letters. A text is rejected when that
spread is above the language's reach and its cosine below the language's radius,
both taken from texts that were held out of the centroids.

The model is fitted on at most PER_LANGUAGE texts of each language, those of
least hash, out of all labelled ones. Only their sparse vectors come to the
driver, so what it holds is bounded by PER_LANGUAGE times the languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams, textvec

BITS = 13
SIZES = (1, 2, 3)
PER_LANGUAGE = 300
CENTROIDS = 3
ROUNDS = 12
#: A radius is the cosine that all but this share of a language's held-out texts reach; texts beyond it are near enough at any spread.
NEAR = 0.1
#: A reach is this many times the spread that all but a hundredth of all held-out texts, or a tenth of the language's own, stay under.
MARGIN = 2.0
UNDETERMINED = "und"


def term_counts(text: str | None) -> np.ndarray | None:
    """Counts of a text's n-gram buckets; None where it has no letter."""
    if not text:
        return None
    stream = ngrams.letter_stream(text)
    if not stream.any():
        return None
    total = np.zeros(1 << BITS, dtype=np.int64)
    for n in SIZES:
        for part in ngrams.segments(stream, n):
            total += np.bincount(ngrams.hashed(part, n, BITS), minlength=1 << BITS)
    return total


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, count, lang = [], [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = term_counts(text)
            if counts is not None:
                where = np.flatnonzero(counts)
                lang.append(label)
                at.append(where.astype(np.uint16).tobytes())
                count.append(counts[where].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(count, pa.binary())], names=["lang", "at", "n"]
        )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of ``x`` from a farthest-first start; the centroids and the cosines of the rows of ``of`` with each."""
    first = _unit(x.mean(axis=0))
    seeds = [x[int(np.argmax(x @ first))]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(np.argmin((x @ np.stack(seeds).T).max(axis=1)))])
    centres = np.stack(seeds)
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([_unit(x[own == j].mean(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres, of @ centres.T


def spread(distinct: np.ndarray | int, cosine: np.ndarray | float) -> np.ndarray | float:
    """The squared tangent of a text's angle to a centroid, for each of its distinct n-grams."""
    return distinct * (1.0 / np.maximum(cosine, 1e-6) ** 2 - 1.0)


def _held_out(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spread and cosine of each distinct row of ``x`` against centroids of the other half of the rows."""
    x = x[np.sort(np.unique([hash(row.tobytes()) for row in x], return_index=True)[1])]
    if len(x) < 2:
        return np.zeros(0), np.zeros(0)
    cosines = np.zeros(len(x))
    for half in (0, 1):
        cosines[half::2] = _cluster(x[1 - half :: 2], CENTROIDS, x[half::2])[1].max(axis=1)
    return spread((x > 0).sum(axis=1), cosines), cosines


class Model:
    """idf, centroids (a row each), their languages, radii and reaches."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], radii: np.ndarray, reaches: np.ndarray):
        self.idf, self.centres, self.langs, self.radii, self.reaches = idf, centres, langs, radii, reaches

    def predict(self, counts: np.ndarray) -> tuple[str, float, bool]:
        x = counts * self.idf
        cosines = self.centres @ x / max(float(np.sqrt(x @ x)), 1e-12)
        best = int(np.argmax(cosines))
        cosine = float(min(1.0, max(0.0, cosines[best])))
        far = cosine < self.radii[best] and spread(int(np.count_nonzero(counts)), cosine) > self.reaches[best]
        return self.langs[best], cosine, bool(far)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model of (language, buckets, counts) rows; without rows every text is undetermined."""
    size = 1 << BITS
    df = np.zeros(size)
    for _, at, _ in rows:
        df[at] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    centres, langs, held = [np.zeros((0, size), np.float32)], [], []
    for lang in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == lang]
        x = np.zeros((len(own), size), dtype=np.float32)
        for k, (_, at, n) in enumerate(own):
            x[k, at] = n * idf[at]
        x = _unit(x)
        found, _ = _cluster(x, CENTROIDS, x[:0])
        held += [_held_out(x)] * len(found)
        centres.append(found.astype(np.float32))
        langs += [lang] * len(found)
    every = np.concatenate([np.zeros(0), *(s for s, _ in {lang: h for lang, h in zip(langs, held)}.values())])
    # Where no language has two texts, nothing tells how far its texts lie, and none is rejected.
    common = float(np.quantile(every, 0.99)) if len(every) else np.inf
    radii = [float(np.quantile(c, NEAR)) if len(c) else 1.0 for _, c in held]
    reaches = [MARGIN * max(common, float(np.quantile(s, 0.9)) if len(s) else 0.0) for s, _ in held]
    return Model(idf, np.concatenate(centres), langs, np.array(radii), np.array(reaches))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model on (key, text, lang) rows: ``per_language`` texts of least hash for each language.

    The hash is of key and text, so rows that repeat a key, or have none,
    spread; rows equal in both count once. The share that a language's hashes
    must lie under comes from its count, so no task sorts a language; the rest
    of the choice is made among the few rows that come to the driver. Every
    language value is learned.
    """
    labelled = labelled.where("lang is not null and text is not null").withColumn("turn", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40)))
    counts = labelled.select("lang", "turn").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    under = F.least(F.lit(1.0), F.lit(2.0 * per_language + 20) / F.col("n")) * float(1 << 40)
    # One row a language, which the model outweighs by its centroids, so it is broadcast; texts are not shuffled for it.
    chosen = labelled.join(F.broadcast(counts), "lang").where(F.col("turn") < under)
    chosen = chosen.groupBy("lang", "turn").agg(F.min("key").alias("key"), F.min("text").alias("text"))
    sparse = chosen.select(F.concat_ws("\x00", "lang", F.col("turn").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit(""))).alias("lang"), "text").mapInArrow(
        _sparse, "lang string, at binary, n binary"
    )
    rows: dict[str, list] = {}
    for r in sparse.collect():
        lang, turn, key = r["lang"].split("\x00", 2)
        rows.setdefault(lang, []).append((int(turn), key, bytes(r["at"]), bytes(r["n"])))
    return fit(
        [
            (lang, np.frombuffer(at, np.uint16), np.frombuffer(n, np.float32))
            for lang in sorted(rows)
            for _, _, at, n in sorted(rows[lang])[:per_language]
        ]
    )


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected added.

    lang_pred is ``und`` with score 0, and rejected, where the text is null or
    has no letter. Nothing but the text is read. Of equal cosines the first
    language by name counts. Rows keep their other columns and repeats; columns
    that are named as the results already are replaced. An empty table gives an
    empty one.
    """
    docs = docs.drop(*[c for c in docs.columns if c != text_col and c.lower() in ("lang_pred", "score", "rejected")])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, text_col):
                found = []
                for text in part.column(part.schema.get_field_index(text_col)).to_pylist():
                    counts = term_counts(text) if len(sent.value.langs) else None
                    found.append((UNDETERMINED, 0.0, True) if counts is None else sent.value.predict(counts))
                lang, score, rejected = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*part.schema.names, "lang_pred", "score", "rejected"],
                )

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return docs.mapInArrow(run, schema)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for documents(doc_id, text, lang); learns from the rows not held out.

    Rows that repeat an id are each predicted, equal ones alike. Null ids count
    as the empty text in the split. Null languages and texts teach nothing;
    null texts and texts without a letter are undetermined. Without labels all
    are. An empty table gives an empty result.
    """
    slim = docs.select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 5) == 0)
    model = train(slim.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify(slim.select("doc_id", "held_out", "text"), model).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the model of their own labels does not reject, columns as they were.

    Null texts and texts without a letter go; repeats stay or go alike. Where
    no language has two texts to measure a reach from, every text with a letter
    stays; without any labelled text all go. An empty table stays empty.
    """
    slim = docs.select(F.col("doc_id").alias("key"), "text", "lang")
    model = train(slim)
    names = [c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected")]
    frame = docs.withColumnsRenamed({n: f"__own_{n}" for n in names})
    kept = identify(frame, model).where("not rejected").drop("lang_pred", "score", "rejected")
    return kept.withColumnsRenamed({f"__own_{n}": n for n in names}).select(*[f"`{c}`" for c in docs.columns])
