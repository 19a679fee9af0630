import random
import re

import numpy as np
import pyarrow as pa

from pressmill.llm import neardup, textvec
from pressmill.llm.components import connected_components
from pressmill.llm.shared import Workspace

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def corpus(seed, bases=12, copies=8, words=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.randrange(6, words))
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_words_and_shingles():
    texts = pa.array(["A b", None, "", "É é x y z w", " a\tb\x0bc\rd e f ", "q" * 2_000_000 + " r s t u v"])
    for t, s in zip(texts.to_pylist(), textvec.shingle_sets(texts)):
        assert len(s) == len(plain_set(t))


def test_matches_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, sizes = plain_components(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_large_buckets_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "OUTSIDE", 6)
    monkeypatch.setattr(neardup, "HUBS", 2)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(70)] = f"e{rng.randrange(5)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base[:20] + [f"z{i}-{k}" for k in range(30)])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)[0]


def test_signature_guarantee():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, size=(200, neardup.SLOTS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.SLOTS, size=neardup.RADIUS, replace=False)
        row[at] ^= 1
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(axis=1).all()


def test_awkward_rows(spark, documents):
    got = neardup.near_duplicates(documents).collect()
    assert len(got) == documents.count()
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[3].component_id == 1 and not by[2].kept and by[1].kept
    assert by[8].component_id == 7 and by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[4].kept and by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert all(r.kept and r.component_id == 10 for r in got if r.doc_id == 10)
    assert neardup.near_duplicates(documents.limit(0)).count() == 0


def test_components(spark):
    edges = [(b"a", b"b"), (b"c", b"b"), (b"x", b"y"), (b"z", b"z"), (None, b"q")] + [(bytes([60 + i]), bytes([61 + i])) for i in range(20)]
    df = spark.createDataFrame([(bytearray(a) if a else None, bytearray(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.component) for r in connected_components(df, Workspace(spark, "t")).collect()}
    assert got[b"c"] == b"a" and got[b"y"] == b"x" and got[bytes([80])] == bytes([60]) and b"z" not in got


def test_cells_guarantee_the_radius():
    rng = np.random.default_rng(12)
    for _ in range(60):
        pair = np.tile(rng.integers(0, 1 << 16, size=neardup.SLOTS, dtype=np.uint16), (2, 1))
        pair[1, rng.choice(neardup.SLOTS, size=neardup.RADIUS, replace=False)] ^= 1
        keys = neardup.chunk_keys(pair)
        for at in np.flatnonzero(keys[0] == keys[1]):
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([b"a", b"b"], pa.binary()),
                    pa.array([9, 9]),
                    pa.array([9, 9]),
                    pa.array(keys[:, at]),
                    pa.array([at // neardup.WIDTH] * 2, pa.int32()),
                    pa.array([x.tobytes() for x in pair], pa.binary()),
                ],
                names=["name", "size", "shared", "key", "chunk", "sig"],
            )
            cells = {b"a": set(), b"b": set()}
            for out in neardup._second_chunks(iter([batch])):
                for row in out.to_pylist():
                    cells[row["name"]].add(row["key"])
            assert cells[b"a"] & cells[b"b"] and len(cells[b"a"]) == 42


def test_refined_buckets_match_brute_force(spark, monkeypatch):
    """Buckets that no component fills are dealt to finer cells; links stay whole."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "OUTSIDE", 3)
    monkeypatch.setattr(neardup, "HUBS", 1)
    dealt = []
    cells = neardup._cells
    monkeypatch.setattr(neardup, "_cells", lambda open_, nodes: dealt.append(1) or cells(open_, nodes))
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for group in range(12):  # texts that share most with others of their group and much with all
        own = list(base)
        for k in range(group * 4, group * 4 + 10):
            own[k % 60] = f"g{group}-{k}"
        for _ in range(4):
            text = list(own)
            text[rng.randrange(60)] = f"e{rng.randrange(3)}"
            rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)[0] and dealt


def test_rounds_do_not_grow_with_a_bucket(spark, monkeypatch):
    """Many texts that share most with each other and are no links: few rounds, few pairs as rows, and the links among them found."""
    for name, value in (("SMALL", 3), ("OUTSIDE", 4), ("HUBS", 1), ("BLOCK", 16)):
        monkeypatch.setattr(neardup, name, value, raising=False)
    rounds, met = [], []
    labels, pairs = neardup.connected_components, neardup._hub_pairs
    monkeypatch.setattr(neardup, "connected_components", lambda *x: rounds.append(1) or labels(*x))
    monkeypatch.setattr(neardup, "_hub_pairs", lambda *x: met.append(pairs(*x).distinct().count()) or pairs(*x))
    rng = random.Random(9)
    pieces = [[f"p{g}-{k}" for k in range(18)] for g in range(12)]  # 36 words of two of 12 passages, after 56 that all share
    rows = []
    for g in range(12):
        for h in range(12):
            text = [f"b{k}" for k in range(56)] + pieces[g] + pieces[h]
            rows.append((len(rows), " ".join(text)))
            if (g + h) % 5 == 0:
                text[rng.randrange(56)] = f"e{rng.randrange(3)}"
                rows.append((len(rows), " ".join(text)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)[0]
    assert len(rounds) <= 5 and sum(met) < len(rows) ** 2 / 4


def test_hub_pairs_are_cut_before_they_are_rows(spark, monkeypatch):
    """Of 60 hubs and nodes of one bucket only the pair whose bit maps allow a link becomes a row."""
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    names = [bytearray([k]) for k in range(60)]
    state = spark.createDataFrame([(1, n, 20, 20, n) for n in names], "key long, name binary, size long, shared long, part binary")
    bits = [(1 << 20) - 1 << 20 * max(k, 1) for k in range(60)]
    maps = spark.createDataFrame([(n, 20, bytearray(b.to_bytes(neardup.MAP_BITS // 8, "little"))) for n, b in zip(names, bits)], "name binary, size long, bits binary")
    got = {(bytes(r.a)[0], bytes(r.b)[0]) for r in neardup._hub_pairs(state, state, maps).collect()}
    assert got == {(0, 1), (1, 0)}


def test_recall_on_a_given_table(spark):
    """All links of ids divisible by 50 against all rows end in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    sets = [x for lo in range(0, len(rows), 500) for x in textvec.shingle_sets(pa.array([r.text for r in rows[lo : lo + 500]], pa.string()))]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner, sizes = flat[order], owner[order], np.array([len(s) for s in sets])
    part = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    links = found = 0
    for k in (k for k, r in enumerate(rows) if r.doc_id % 50 == 0 and len(sets[k])):
        lo, hi = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        both = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo, hi)]), minlength=len(sets))
        for other in np.flatnonzero(100 * both >= 75 * (sizes + sizes[k] - both)):
            if other != k:
                links += 1
                found += part[rows[k].doc_id] == part[rows[other].doc_id]
    assert links >= 70 and found == links


def test_ids_of_other_types(spark):
    got = neardup.near_duplicates(spark.createDataFrame([("b", "one two three"), ("a", "One two three"), (None, "x")], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {("a", "a", True), ("b", "a", False), (None, None, True)}
