import random

import numpy as np
import pyarrow as pa
import pytest

from pressmill.llm import decontam, textvec

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def plain_matches(docs, items):
    """Best weighted similarity over every window of an item's length, where it reaches the threshold."""
    def shingles(texts):
        raw, at = textvec.buffers(pa.array(texts, pa.string()))
        words, _, bounds = textvec.word_hashes(raw, at)
        return list(zip(textvec.all_shingles(words, bounds), np.diff(bounds).tolist()))

    out = {}
    for (doc, _), (s, n) in zip(docs, shingles([t for _, t in docs])):
        for (item, _), (q, m) in zip(items, shingles([t for _, t in items])):
            if not set(s.tolist()) & set(q.tolist()):
                continue  # similarity 0 everywhere
            wide = max(1, min(n, m) - 4)
            best = max((decontam.weighted_jaccard(s[p : p + wide], q) for p in range(len(s) - wide + 1)), default=0) if len(s) and len(q) else 0
            if best >= 0.75:
                out[doc, item] = pytest.approx(best)
    return out


def test_finds_what_brute_force_finds(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 50)))) for i in range(25)]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randrange(0, 200))
        if d % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                passage[rng.randrange(len(passage))] = "edit"
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((d, " ".join(text)))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), items_at_once=10)
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    want = plain_matches(docs, items)
    assert want and set(got) <= set(want) and len(got) >= 0.98 * len(want) and all(want[k] == v for k, v in got.items())


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(3)
    items = decontam.Items(list(range(40)), [" ".join(f"q{i}-{k}" for k in range(30)) for i in range(40)])
    for k in range(40):
        bits = np.unpackbits(items.prints[k])
        bits[rng.choice(decontam.BITS, size=decontam.RADIUS, replace=False)] ^= 1
        assert k in items.near(np.packbits(bits)[None])[1]


def test_blocks_select():
    """Few unrelated items are met by a window, and those that are lie beyond the radius."""
    items = decontam.Items(list(range(400)), [" ".join(f"q{i}-{k}" for k in range(35)) for i in range(400)])
    rng = np.random.default_rng(9)
    prints = np.stack([decontam.fingerprint(rng.integers(0, 2**63, size=31, dtype=np.uint64)) for _ in range(200)])
    rows, met = items.met_by(prints)
    share = len(np.unique(rows * 400 + met)) / (200 * 400)
    assert 0.10 < share < 0.20 and len(items.near(prints)[0]) == 0


def test_ties_ids_and_awkward_tables(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = [("d1", f"{item} and {item}"), ("d1", f"{item} and {item}"), (None, item), ("d2", None), ("d3", ""), ("d4", "x " * 200_000 + item)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id string, text string, similarity string")
    bench = spark.createDataFrame([(1.5, item), (1.5, item), (2.5, item), (None, None), (3.5, " ")], "item_id double, text string")
    got = sorted((r.doc_id or "", r.item_id, r.similarity, r.first_word) for r in decontam.contaminated(df, bench).collect())
    assert got == sorted((d, i, 1.0, at) for d, at in (("", 0), ("d1", 0), ("d1", 0), ("d4", 200_000)) for i in (1.5, 2.5))
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0
    assert sorted(r.doc_id or "" for r in decontam.decontaminate(df, bench).collect()) == ["", "d2", "d3"]


def test_recall_on_the_given_tables(spark):
    """Against every window of every document that shares a shingle with an item."""
    import duckdb

    read = lambda t, c: duckdb.sql(f"select {c} from '/root/testdata/sf0.01/{t}.parquet' where text is not null").fetchall()
    docs, items = read("documents", "doc_id, text"), read("benchmark", "item_id, text")
    want = plain_matches(docs, items)
    found = decontam.contaminated(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert want and set(got) == set(want) and all(want[k] == v for k, v in got.items())


def test_awkward_rows(spark, documents):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "ONE two"), (4, "a b c d e f g")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(documents, items).collect())
    assert got == [(7, 3), (8, 3)]
    left = decontam.decontaminate(documents, items)
    assert left.columns == documents.columns and left.count() == documents.count() - 2
    assert decontam.contaminated(documents, items.limit(0)).count() == 0 and decontam.contaminated(documents.limit(0), items).count() == 0


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    steps = dict(pipeline.STAGES)
    first = steps["language"](spark, docs, DATA)
    assert first.columns == docs.columns and sorted(ids(first)) == sorted(ids(docs))
    second = steps["near_duplicates"](spark, first, DATA)
    from tests.llm.test_neardup import plain_components

    want, _ = plain_components([(r.doc_id, r.text) for r in first.collect()])
    assert sorted(ids(second)) == sorted(set(want.values()))
    third = steps["decontamination"](spark, second, DATA)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {d for d, _ in plain_matches([(r.doc_id, r.text) for r in second.collect()], items)}
    assert sorted(ids(third)) == sorted(set(ids(second)) - bad)
    out = pipeline.run(spark, DATA)
    assert out.count() == steps["mixing"](spark, third, DATA).count() and {"doc_id", "shard"} <= set(out.columns)


def test_stages_on_awkward_rows(spark, documents, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (documents, documents.limit(0)):
        docs = rows
        for k, (name, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == len(pipeline.STAGES) - 1 or out.columns == documents.columns
            out.write.parquet(where := f"{tmp_path}/{name}-{rows is documents}")
            docs = spark.read.parquet(where)
