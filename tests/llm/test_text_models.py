import collections
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import language, ngrams, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows)


def test_language_rejects_noise(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    noise = spark.createDataFrame([("qxzjk wvqj xkzq jjxq zzkw qvxj kqzx wjvz xqkj vzqw",), ("Ωμέγα βήτα δέλτα",), (None,), ("",), ("12 !",)], "text string")
    got = language.identify(noise, model).collect()
    assert all(r.rejected for r in got) and [r.lang_pred for r in got[2:]] == ["und"] * 3


FOREIGN = (
    "Rada miasta przyjęła wczoraj budżet na przyszły rok, a mieszkańcy mogą zgłaszać uwagi do końca miesiąca. Nowe przepisy wejdą w życie jesienią.",
    "Belediye meclisi dün gelecek yılın bütçesini kabul etti ve vatandaşlar ay sonuna kadar görüşlerini bildirebilir. Yeni kurallar sonbaharda gelecek.",
    "Kaupunginvaltuusto hyväksyi eilen ensi vuoden talousarvion, ja asukkaat voivat jättää huomautuksia kuun loppuun asti. Uudet säännöt tulevat voimaan.",
    "Baraza la jiji lilipitisha jana bajeti ya mwaka ujao, na wakazi wanaweza kutoa maoni yao hadi mwisho wa mwezi. Kanuni mpya zitaanza kutumika baadaye.",
    "Il consiglio comunale ha approvato ieri il bilancio del prossimo anno e gli abitanti possono presentare osservazioni fino alla fine del mese.",
    "De gemeenteraad heeft gisteren de begroting voor volgend jaar goedgekeurd en inwoners kunnen tot het einde van de maand opmerkingen indienen.",
    "def run(x, y):\n    for i in range(len(x)):\n        if x[i] != y[i]:\n            return False\n    return True\n\nclass Node:\n    def __init__(self, left):\n        self.left = left",
)


def test_language_rejects_unlearned_latin_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    rng = random.Random(1)
    texts = [*FOREIGN, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(60))]
    for r in docs.where("length(text) between 1000 and 5000").orderBy("doc_id").limit(20).collect():
        marks = [c for c in r.text if c.isalpha()]
        rng.shuffle(marks)
        texts.append("".join(marks.pop() if c.isalpha() else c for c in r.text))
    got = [model.predict(language.term_counts(t)) for t in texts]
    assert all(r[2] for r in got[: len(FOREIGN) + 1]) and sum(r[2] for r in got) >= len(got) - 2
    for lang in ("fr", "en", "de", "es"):
        rest = language.train(docs.where(F.col("lang") != lang).select(F.col("doc_id").alias("key"), "text", "lang"))
        out = language.identify(docs.where(F.col("lang") == lang), rest).collect()
        assert sum(r.rejected for r in out) >= 0.9 * len(out)


def test_language_learns_every_value(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, (letters[i % 26] + letters[i // 26]) * 5 + " " + chr(0x4E00 + i) * 4, f"l{i:03}") for i in range(230)]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    assert language.train(docs).langs == sorted(r[2] for r in rows)


def test_language_awkward_rows(documents):
    got = {r.doc_id: r for r in language.language_predictions(documents).collect()}
    assert len(got) == documents.select("doc_id").distinct().count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 11)) and got[1].lang_pred in ("en", "fr", "de")
    assert language.language_predictions(documents.limit(0)).count() == 0
    kept = language.keep_identified(documents)
    assert kept.columns == documents.columns and kept.where("doc_id in (4, 5, 6, 11)").count() == 0 and kept.where("doc_id = 10").count() == 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("tha", "ren", "sho", "mil") for b in ("ed", "ion", "er") for c in ("", "s", "ly")]
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = rng.choices(words, k=rng.randrange(20, 200)) + (rng.choices(["grunchface", "blorphead", "zugfool"], k=3) if bad else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in held if r.toxic) >= 0.9 * sum(r.toxic for r in held)
    assert not any(r.predicted for r in held if not r.toxic)


def test_toxicity_awkward_rows(spark, documents, labelled):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (77, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(documents, labels).collect()
    assert len(rows) == documents.count() and len({r.score for r in rows}) == 1
    assert toxicity.toxicity_scores(documents, labels.limit(0)).count() == documents.count()
    assert toxicity.toxicity_scores(documents.limit(0), labels).count() == 0


def plain_bucket(points, bits):
    """One n-gram's bucket, in Python integers."""
    h, top = len(points), (1 << 64) - 1
    for k, c in enumerate(points):
        h = (h + int(c) * int(ngrams._MUL[k])) & top
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & top
    return h >> (64 - bits)


def test_toxicity_scores_equal_a_plain_version(spark, labelled):
    docs, labels = labelled
    known = docs.select(F.col("doc_id").alias("key"), "text")
    model = toxicity.train(known, labels.withColumnRenamed("doc_id", "key"), per_class=60)
    rows = toxicity.score_toxicity(docs.limit(25).unionByName(spark.createDataFrame([(-1, "Grunchface ÉÉ"), (-2, ""), (-3, None)], "doc_id long, text string")), model).collect()
    text_of = {r.doc_id: r.text for r in docs.collect()} | {-1: "Grunchface ÉÉ", -2: "", -3: None}
    for r in rows:
        stream = [32, *map(ord, text_of[r.doc_id].lower()), 32] if text_of[r.doc_id] else []
        found = {plain_bucket(stream[i : i + n], toxicity.BITS) for n in toxicity.SIZES for i in range(len(stream) - n + 1)}
        z = model.bias + sum(float(model.weights[k]) for k in sorted(found))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r.predicted == int(r.score >= 0.7)
    assert len(np.flatnonzero(model.weights)) > 0


def test_toxicity_reads_few_texts(spark, labelled, monkeypatch):
    docs, labels = labelled
    known = docs.select(F.col("doc_id").alias("key"), "text")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda lists, y, prior: seen.append((len(lists), int(y.sum()), prior)))
    toxicity.train(known.unionByName(known), labels.withColumnRenamed("doc_id", "key"), per_class=40)
    assert seen == [(80, 40, pytest.approx(0.25))]  # repeated rows count once


def test_small_toxicity_tables_still_predict():
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 5000, size=60)) for _ in range(90)]
    lists = [np.unique(np.append(x, [7001, 7002, 7003, 7004, 7005, 7006])) if i < 12 else x for i, x in enumerate(lists)]
    y = (np.arange(90) < 12).astype(int)
    model = toxicity.fit(lists, y, 0.13)
    z = np.array([model.bias + model.weights[x].sum() for x in lists])
    assert (z[y == 1] > math.log(0.7 / 0.3)).all() and (z[y == 0] < 0).all()


def test_language_predictions_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.select(F.col("doc_id").alias("key"), "text", "lang"), per_language=8)
    rows = docs.where("text is not null").orderBy("doc_id").limit(15).collect()
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for r in rows:
        words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in r.text.lower()).split()
        stream = [0, *[p for w in words for p in (*map(ord, w), 0)]]
        counts = np.zeros(1 << language.BITS)
        for n in language.SIZES:
            for i in range(len(stream) - n + 1):
                counts[plain_bucket(stream[i : i + n], language.BITS)] += 1
        x = counts * model.idf
        cosines = [float(c @ x / math.sqrt(x @ x)) for c in model.centres]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[r.doc_id].lang_pred == model.langs[best] and got[r.doc_id].score == pytest.approx(cosines[best], abs=1e-5)


def test_language_ties_and_repeats(spark):
    same = "the same words are said in both of these two languages today"
    rows = [(i, f"{same} x{i % 3}", lang) for i in range(30) for lang in ("bb", "aa")]
    model = language.train(spark.createDataFrame(rows, "key long, text string, lang string"))
    got = language.identify(spark.createDataFrame([(same, "mine"), (same, "mine")], "text string, lang_pred string"), model).collect()
    assert [r.lang_pred for r in got] == ["aa", "aa"] and got[0] == got[1]


def test_rows_without_ids_stay_bounded(spark, monkeypatch):
    rows = [(None, f"word{i} alpha beta {i * 7}", "en") for i in range(3000)] + [(None, "copy of one text", "fr")] * 3000
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "fit", lambda found: seen.append(collections.Counter(r[0] for r in found)))
    language.train(df, per_language=20)
    assert seen == [{"en": 20, "fr": 1}]
