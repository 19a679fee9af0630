import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.llm import exact_dedup, fill_middle, lexical_search

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", "character": r"(?s:.)"}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
pieces = st.lists(st.sampled_from(["a", "Bé", "\n", "\n\n", " ", "\t ", "<", "<P", "P>", "<P>", "<S>", "<M>", "x" * 40, "日本", "\x1f", " ", "\r\n"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces, st.sampled_from(sorted(UNIT)))
def test_events_count_and_place_units(text, unit):
    scanner = fill_middle.Scanner(unit)
    ends, held = scanner.events(text)
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text and scanner.count(ends, len(text)) == len(units) and held == any(s in text for s in fill_middle.SENTINELS)
    for rank in range(len(units) + 1):
        assert scanner.place(ends, len(text), rank) == len("".join(units[:rank]))


def cut(row, unit="line", seed=7, fim=100, spm=50):
    text, digest = row.text or "", hashlib.sha256(f"{seed}:{'' if row.doc_id is None else row.doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(UNIT[unit], text)
    n = len(units)
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm_form = h[3] % 100 < spm
    return n, "spm" if spm_form else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "fim", "spm"), [("line", 100, 50), ("word", 60, 0), ("character", 100, 100)])
def test_fill_in_middle_equals_plain_cuts(spark, documents, unit, fim, spm):
    more = spark.createDataFrame([(20 + k, f"line {k}\nΣ two\n\nlast<" + ("\n" if k % 3 else "") + ("<S>" if k % 11 == 5 else "")) for k in range(60)], "doc_id long, text string")
    docs = documents.select("doc_id", "text", "lang", F.lit("clash").alias("output"), F.lit(1).alias("h1")).unionByName(more, allowMissingColumns=True)
    got = fill_middle.fill_in_middle(docs, unit=unit, fim_percent=fim, spm_percent=spm).withColumn("back", fill_middle.restored())
    key = lambda x: tuple(map(str, x))
    want = [(r.doc_id, *cut(r, unit, 7, fim, spm), r.text or "") for r in docs.collect()]
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(want, key=key)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_refuses_sentinels_that_could_arise(spark, documents):
    for bad in (("<P>", "<S>", "<S>"), ("<<", "<S>", "<M>"), ("", "<S>", "<M>"), ("a<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(documents, sentinels=bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "é", "9", " ", "-", "_", "日本", "\x7f", "\x80", "\n"]), max_size=30).map("".join), st.integers(1, 7))
def test_terms_in_segments(text, size):
    whole, lexical_search.SEGMENT = lexical_search.SEGMENT, size
    try:
        assert [w.decode() for part in lexical_search.terms_of(text.encode()) for w in part] == [t.translate(FOLD) for t in TERM.findall(text)]
    finally:
        lexical_search.SEGMENT = whole


def plain_search(docs, items, top=10):
    counts = [(d.doc_id, Counter(t.translate(FOLD) for t in TERM.findall(d.text or ""))) for d in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in items:
        scores = []
        for doc_id, c in counts:
            n, score = sum(c.values()), 0
            for t in {t.translate(FOLD) for t in TERM.findall(item.text or "")} & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * n * n_docs) // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item.item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "item_bytes"), [(64, 4 << 20), (2, 40), (1, 1)])
def test_search_equals_plain_ranking(spark, documents, size, item_bytes):
    docs = documents.unionByName(spark.createDataFrame([(30 + k, f"tie words {'beta1' if k % 2 else 'words'} one {k % 3}") for k in range(40)], "doc_id long, text string"), allowMissingColumns=True)
    items = spark.createDataFrame(
        [(1, "One two words"), (2, None), (3, ""), (4, "beta1 alpha0 gamma2 beta1"), (5, "nowhere"), (1, "tie WORDS 12345"), (None, "number one"), (7, "!?")], "item_id long, text string"
    ).withColumn("doc_id", F.lit(1))
    got = lexical_search.lexical_search(docs, items, size=size, item_bytes=item_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs.collect(), items.collect())
    assert lexical_search.lexical_search(docs.limit(0), items).count() == lexical_search.lexical_search(docs, items.limit(0)).count() == 0


def test_search_prunes_blocks_and_loses_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    terms = [np.unique(rng.integers(0, 200, 6)) for _ in range(20)]
    weights = rng.integers(1, 5000, 200)
    blocks = []
    for k in range(300):
        hot = rng.integers(0, 200, 12)
        post = sorted({(int(rng.choice(hot)), int(d)) for d in range(16) for _ in range(5)})
        t, places = (np.array(x) for x in zip(*post))
        gains = rng.integers(1, 100, len(post))
        own, starts = np.unique(t, return_index=True)
        blocks.append((np.arange(16) + 16 * k, own, np.maximum.reduceat(gains, starts), np.append(starts[1:], len(post)), places, gains))
    search = lexical_search.Search(terms, weights, 10)
    for k in range(0, 300, 50):
        search.take(blocks[k : k + 50])
    for i, asked in enumerate(terms):
        scores = Counter()
        for ids, own, _, stops, places, gains in blocks:
            for j, t in enumerate(own.tolist()):
                if t in asked:
                    for p in range(stops[j - 1] if j else 0, stops[j]):
                        scores[int(ids[places[p]])] += int(weights[t] * gains[p])
        want = sorted(((-s, d) for d, s in scores.items() if s > 0))[:10]
        assert [(-s, d) for s, d in zip(search.best[i][1].tolist(), search.best[i][0].tolist())] == want
    assert search.scored < 0.6 * 300 * len(terms)


@pytest.mark.parametrize(("block", "head"), [(1024, 64), (4, 2), (1, 1)])
def test_copies_equal_plain_groups(spark, documents, block, head):
    rows = [(100 + k, x) for k, x in enumerate(["abcdefgh" * 40, "abcdefgh" * 39 + "abcdefgx", "ABCDEFGH" * 40, "É", "é", "éA", "Éa", "aaaa", "aaa", "aaaaaaaa", "aaaaaaa ", "aaaaaaaa", "bb" * 7, "bb" * 6 + "bc", "bb" * 7])]
    small = documents.where("doc_id is null or doc_id != 9") if block < 64 else documents
    docs = small.select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("name")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        best = ids.index(last)
        want += [(i, last, len(ids), k == best, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    got = exact_dedup.exact_duplicates(docs, block=block, head=head)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_copies_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
