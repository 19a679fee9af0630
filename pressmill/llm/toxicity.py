"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it contains (lower-cased,
present or not). Feature j has the ratio r_j = log((p_j / |p|) / (q_j / |q|)) of
smoothed counts in toxic and other training texts; the vector, scaled by r, goes
to a logistic regression. N-grams in fewer than LEAST_TEXTS texts of a class or
with a small ratio take no part, so that long clean texts gather no noise.

Training reads at most PER_CLASS labelled texts of each label, those of least
hash; only their feature lists come to the driver. The model is a table of 2^BITS
weights, whatever the input; the regression's penalty, not a count of features,
holds them down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams, textvec
from .language import fold
from .shared import Workspace

BITS = 19
SIZES = (4, 6, 8)
PER_CLASS = 1200
LEAST_TEXTS = 3
LEAST_RATIO = 1.5
STEPS = 250
PENALTY = 0.001
#: Models of so many folds calibrate the scores; with few labelled texts each must learn from nearly all of them.
FOLDS, LEAST_FOLDS = 8, 3
THRESHOLD = 0.7


def _stream(text: str) -> np.ndarray:
    return np.concatenate([[np.uint32(32)], ngrams.code_points(text.lower()), [np.uint32(32)]])


def present(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct feature buckets of a text, only those marked in ``wanted`` if given."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    stream, found = _stream(text), []
    for n in SIZES:
        for part in ngrams.segments(stream, n):
            h = ngrams.hashed(part, n, BITS)
            found.append(np.unique(h if wanted is None else h[wanted[h]]))
    return np.unique(np.concatenate(found))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.slices(batch, "text"):
            lists = [present(t).astype(np.uint32).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lists, pa.binary())], names=["key", "toxic", "at"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.wanted = self.weights != 0

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[present(text, self.wanted)].sum(dtype=np.float64))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _weights(labels: np.ndarray, prior: float) -> np.ndarray:
    """Row weights that give label 1 the share ``prior``."""
    share = np.where(labels == 1, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
    return share / share.sum()


def _fit_once(lists: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    size = 1 << BITS
    p, q = np.zeros(size), np.zeros(size)
    for at, y in zip(lists, labels):
        (p if y else q)[at] += 1
    df = np.maximum(p, q)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    good = np.flatnonzero((df >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO))
    place = np.full(size, -1)
    place[good] = np.arange(len(good))
    found = [place[at] for at in lists]
    found = [c[c >= 0] for c in found]
    rows = np.repeat(np.arange(len(lists)), [len(c) for c in found])
    cols = np.concatenate(found)
    values, y, share = ratio[good][cols], labels.astype(float), _weights(labels, prior)
    w, b = np.zeros(len(good)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(good) + 1), np.zeros(len(good) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, weights=values * w[cols], minlength=len(lists))
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(cols, weights=values * error[rows], minlength=len(good)) + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size)
    weights[good] = w * ratio[good]
    return Model(weights, b)


def fit(lists: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """A model of feature lists and 0/1 labels; ``prior`` is the share of label 1 among all labelled texts.

    Scores are calibrated: FOLDS models (fewer where a label has fewer texts) score the texts that they haven't seen,
    and the slope and offset that fit those scores to the labels go into the model.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    folds = int(min(FOLDS, labels.sum(), (1 - labels).sum())) if len(lists) else 0
    if folds < LEAST_FOLDS:
        return Model(np.zeros(1 << BITS), np.log(prior / (1 - prior)))
    model = _fit_once(lists, labels, prior)
    fold_of = np.empty(len(labels), dtype=int)
    for y in (0, 1):
        fold_of[labels == y] = np.arange((labels == y).sum()) % folds
    z = np.empty(len(labels))
    for k in range(folds):
        seen = np.flatnonzero(fold_of != k)
        part = _fit_once([lists[i] for i in seen], labels[seen], prior)
        for i in np.flatnonzero(fold_of == k):
            z[i] = part.bias + part.weights[lists[i]].sum(dtype=np.float64)
    share, y = _weights(labels, prior), labels.astype(float)
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        h = share * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(share * (p - y) * z).sum(), (share * (p - y)).sum()])
        hess = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-12))
        slope, offset = max(0.1, slope - move[0]), offset - move[1]
    return Model(model.weights * slope, model.bias * slope + offset)


def chosen_rows(marks: DataFrame, per_class: int, space: Workspace) -> tuple[list[tuple], float]:
    """(key, text_hash, toxic) of ``per_class`` rows of least hash for each label, and label 1's share of all rows.

    ``marks`` has (key, text_hash, toxic) and no texts. The hash covers both,
    so rows that repeat an id spread; equal rows count once.
    """
    marks = space.keep(marks.where("toxic in (0, 1)").distinct().withColumn("turn", F.xxhash64("key", "text_hash")), "marks")
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = []
    for label in (0, 1):
        rows += marks.where(F.col("toxic") == label).orderBy("turn", "key", "text_hash").limit(per_class).collect()
    return [(r["key"], r["text_hash"], int(r["toxic"])) for r in rows], n.get(1, 0) / max(1, sum(n.values()))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits a model on (key, text) rows of ``docs`` and (key, toxic) rows of ``labels``, one for each key.

    Ids, text hashes and labels choose at most ``per_class`` rows of each
    label; only then are those rows' texts read, by a join with the few chosen
    ones, which are broadcast. Only their feature lists come to the driver.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "toxicity")
    hashed = docs.where("key is not null").withColumn("text_hash", F.xxhash64("text"))
    rows, prior = chosen_rows(hashed.select("key", "text_hash").join(labels, "key"), per_class, space)
    if not rows:
        return fit([], np.zeros(0), 0.5)
    kind = docs.schema["key"].dataType.simpleString()
    chosen = spark.createDataFrame(rows, f"key {kind}, text_hash long, toxic int")
    texts = hashed.join(F.broadcast(chosen), ["key", "text_hash"]).groupBy("key", "text_hash", "toxic").agg(F.min("text").alias("text"))
    sent = texts.select(F.xxhash64("key", "text_hash").alias("key"), "toxic", "text").mapInArrow(_features, "key long, toxic int, at binary")
    # One partition at a time, as views of the received bytes: the driver holds the lists once.
    lists = [(r["toxic"], r["key"], np.frombuffer(r["at"], np.uint32)) for r in sent.toLocalIterator()]
    lists.sort(key=lambda r: r[:2])
    return fit([r[2] for r in lists], np.array([r[0] for r in lists]), prior)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(all columns but the text), score, predicted; null and empty texts score as texts without features.

    Columns that are named score or predicted already are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f.name for f in docs.schema.fields if f.name != text_col and f.name.lower() not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, text_col):
                score = np.array([sent.value.score(t) for t in part.column(part.schema.get_field_index(text_col)).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in rest), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=[*rest, "score", "predicted"],
                )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", score double, predicted int"
    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labelled rows that are not held out.

    Several labels of one id count as the greatest; rows that repeat an id are
    each scored, equal ones alike. Null ids learn nothing and are scored. Null,
    empty and blank texts score as texts without features. Ids without a label
    only get a score; without labels of both kinds every text scores the prior.
    An empty table of documents gives an empty result.
    """
    slim = docs.select("doc_id", "text").withColumn("held_out", fold("doc_id", 3) == 1)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    known = slim.where("not held_out").select(F.col("doc_id").alias("key"), "text")
    return score_toxicity(slim, train(known, marks)).select("doc_id", "held_out", "score", "predicted")
