import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pressmill.llm import pii, quality, tokens
from pressmill.llm.shared import Workspace

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.load_merges(PATH)), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", "'s", "<|endoftext|>", "<|", " ", "\n", "　", "\x1c", "É", "Σ", "9", "!?", "日本", "🙂", "é"]), max_size=30).map("".join))
def test_token_counts_equal_library(counter, text):
    own, library = counter
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_documents(spark, counter):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in tokens.token_counts(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == len(counter[1].encode(r.text, add_special_tokens=False).ids) and r.n_bytes == len(r.text.encode())
        assert r.over_limit == (r.n_tokens > 2048)


def test_token_awkward_rows(documents):
    got = {r.doc_id: r for r in tokens.token_counts(documents, PATH).collect()}
    assert got[4].n_tokens == got[5].n_tokens == got[6].n_tokens == 0 and got[4].n_bytes == 0 and got[9].over_limit
    assert tokens.token_counts(documents.limit(0), PATH).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 10 <= len(digits) <= 15
            ):
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


CASES = [
    "mail a@b.co and c.d_e@f-g.h.i, x@y. z@@w.q é🙂 q@r.st",
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 x4111111111111111x 1 2 3",
    "+1 (743) 555-3824, +44 20 7946 0958 +123 +1(2)3.4-5",
    "card 4242424242424242 phone +15555550100 ip 10.0.0.1 mail q@r.st " * 30,
    "1" * 1_500 + "@" + "a" * 1_500,
    None,
    "",
]


def test_base_spans_equal_plain_version(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, text in enumerate(CASES):
        want, n = base_spans(text), collections.Counter(s[2] for s in base_spans(text))
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [n[k] for k in PATTERNS], text and text[:60]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(rows[i].spans.split(","))


def test_model_adds_what_resembles_the_base(spark):
    texts = [f"word call +1 ({200 + i % 700}) 555-{1000 + i} soon" for i in range(900)] + [f"version {i}.{i % 9} of {i * 1000003 % 99991} pieces, lot {10**8 + i * 7}" for i in range(300)]
    texts += ["word call 1 (222) 555-9999 soon", "only 1234567 pieces"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert rows[1200].added.startswith("phone:10:") and rows[1201].added == "" and rows[1200].n_phone == 0


def test_pii_awkward_rows(documents):
    assert pii.find_personal_data(documents).count() == documents.count()
    assert pii.find_personal_data(documents.limit(0)).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = collections.Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(documents.select("doc_id", "text", "lang", "source"), True)
    odd = spark.createDataFrame([(5001, "a b a b a b a", "en", "s"), (5002, "x\n x\nx\n\n", "en", "s"), (5003, "a a a a", "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd, True)
    for r in quality.text_statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(r.text)


def test_quality_verdicts(spark, documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_filter(docs).join(labels, "doc_id").collect()
    assert all(not r.kept for r in rows if r.base_failed)
    clean, junk = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert all(r.kept for r in clean) and sum(not r.kept for r in junk) >= 0.95 * len(junk)
    assert quality.quality_filter(documents).count() == documents.count() and quality.quality_filter(documents.limit(0)).count() == 0


def test_quality_each_statistic_rejects(spark):
    rng = random.Random(4)
    word = lambda n=5: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    line = lambda n, size=5: " ".join(word(rng.randrange(size - 2, size + 3)) for _ in range(n))
    usual = ["\n".join(line(rng.randrange(18, 32)) for _ in range(10)) for _ in range(200)]
    phrases = [line(10) for _ in range(10)]
    odd = {
        "length": "\n".join(line(30) for _ in range(300)),
        "word": "\n".join(line(25, 11) for _ in range(10)),
        "symbols": "\n".join(line(25) + " ####" for _ in range(10)),
        "repeats": " ".join(f"{x} {line(3)} {x} {line(24)}" for x in phrases),
        "lines": "\n".join(f"{line(20)}\nsame" for _ in range(12)),
        "lines and repeats": "\n".join([line(20) for _ in range(6)] + [line(8)] * 6 + phrases[:6]),
    }
    fine = {"one line twice": "\n".join([line(20) for _ in range(5)] + [phrases[0]] * 2), "one phrase twice": f"{phrases[0]} {line(40)} {phrases[0]}"}
    rows = [(str(i), t, "en", "s") for i, t in enumerate(usual)] + [(k, t, "en", "s") for k, t in (odd | fine).items()]
    got = {r.doc_id: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()}
    assert not any(got[k].base_failed for k in odd)
    assert [k for k in odd if got[k].kept] == [] and all(got[k].kept for k in fine)
    assert sum(not got[str(i)].kept for i in range(200)) <= 2


def plain_determinant(x, starts=40):
    """The least regularised log determinant over many starts of concentration steps, and its distances."""
    rng, best = np.random.default_rng(1), (np.inf, None)
    ridge = np.diag([quality.FLOORS[n] ** 2 for n in quality.NAMES])
    for _ in range(starts):
        core, seen = rng.choice(len(x), 12, replace=False), None
        while seen is None or set(core) != seen:
            seen = set(core)
            scatter = quality.CONSISTENCY * np.cov(x[core].T, bias=True) + ridge
            off = x - x[core].mean(axis=0)
            d2 = (off @ np.linalg.inv(scatter) * off).sum(axis=1)
            core = np.argsort(d2, kind="stable")[: int(np.ceil(quality.CORE * len(x)))]
        scatter = quality.CONSISTENCY * np.cov(x[core].T, bias=True) + ridge
        best = min(best, (np.linalg.slogdet(scatter)[1], tuple(d2)), key=lambda b: b[0])
    return best


def test_quality_least_determinant(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal([5, 5, 0.2, 0.3, 0.3], [0.8, 0.6, 0.05, 0.1, 0.1], size=(240, 5))
    x[:50] += [6, -4, 0.5, 0.5, 0.5]  # a tight group of outliers, which draws means and deviations
    rows = [("g", i % quality.SALT, i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "`group` string, salt int, pick long, " + ", ".join(f"{n} double" for n in quality.NAMES))
    params = quality.robust_parameters(df, Workspace(spark, "t")).collect()
    want, far = plain_determinant(x)
    assert len(params) == 1 and params[0].logdet <= want + 0.05
    low = np.array([[params[0][f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    off = x - np.array([params[0][f"m_{i}"] for i in range(5)])
    d2 = (np.linalg.solve(low, off.T) ** 2).sum(axis=0)
    assert (d2[:50] > quality.CUTOFF).all() and (d2[50:] <= quality.CUTOFF).mean() > 0.97
    assert np.allclose(d2[50:], np.array(far)[50:], rtol=0.35, atol=1.0)


def luhn_number(rng, n=16):
    digits = [rng.randrange(1, 10)] + [rng.randrange(10) for _ in range(n - 2)]
    for last in range(10):
        if luhn("".join(map(str, digits + [last]))):
            return "".join(map(str, digits + [last]))


def no_card(rng):
    while True:
        number = str(rng.randrange(10**15, 10**16))
        if not luhn(number):
            return number


def test_model_finds_disguised_spans(spark):
    """Spans whose deciding mark is disguised are found by the model alone; other numbers and handles stay."""
    rng = random.Random(3)
    four = lambda s, mark: mark.join(s[i : i + 4] for i in range(0, 16, 4))
    ip = lambda: [str(rng.randrange(1, 255)) for _ in range(4)]
    texts, planted = [], {}
    for i in range(600):
        texts.append(f"please mail jane{i}@site{i % 40}.com or call +1 (415) 555-{1000 + i} today")
        texts.append(f"the card {four(luhn_number(rng), ' -'[i % 2])} was used from host {'.'.join(ip())} then")
        texts.append(f"bot@{i} wrote release {i % 9}.{i % 7}.{i % 5} on 2024-0{1 + i % 9}-1{i % 9} with {rng.randrange(10**6, 10**9)} rows at {rng.randrange(300, 999)}.{i % 300}.{i % 9}.1 for 1{i:03}.50")
        texts.append(f"serial {rng.randrange(10**15, 10**16 - 10)}1 and build {four(no_card(rng), '.')} part 19{i % 90 + 10}-20{i % 25 + 10} x")
    for i in range(60):
        found = {
            "email": f"joe{i} [at] home{i}.org",
            "card": four(luhn_number(rng), "."),
            "ip": "[.]".join(ip()),
            "phone": f"(415) 555-{2000 + i}",
        }
        for kind, span in found.items():
            planted[len(texts)] = (kind, span)
            cue = {"email": "please mail", "card": "the card", "ip": "from host", "phone": "or call"}[kind]
            texts.append(f"{cue} {span} then")
    rows = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    caught = collections.Counter()
    for at, (kind, span) in planted.items():
        start = texts[at].index(span)
        assert rows[at].n_email + rows[at].n_ip + rows[at].n_card + rows[at].n_phone == 0  # the base finds none
        caught[kind] += rows[at].added == f"{kind}:{start}:{start + len(span)}"
    assert all(caught[k] >= 54 for k in PATTERNS), caught
    assert sum(rows[i].added != "" for i in range(2400)) <= 12


def planted_texts(rng):
    """Texts of sf0.01 with plain spans, hard numbers and disguised spans put between their words; (texts, disguised, hard)."""
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    four = lambda s, mark: mark.join(s[i : i + 4] for i in range(0, 16, 4))
    ip = lambda: [str(rng.randrange(1, 255)) for _ in range(4)]
    plain = {
        "email": lambda i: f"mail jane{i}@site{i % 40}.com",
        "card": lambda i: f"paid by card {four(luhn_number(rng), ' -'[i % 2])}",
        "ip": lambda i: f"from host {'.'.join(ip())}",
        "phone": lambda i: f"or call +1 {('(415) 555-', '415 555 ')[i % 8 > 3]}{1000 + i}",
    }
    hard = {
        "email": lambda i: f"thanks bot{i % 30}@{i % 50}",
        "card": lambda i: f"serial {four(no_card(rng), '.- '[i % 3])}",
        "ip": lambda i: f"release {rng.randrange(300, 999)}.{i % 300}.{i % 9}.1",
        "phone": lambda i: f"lot {10**9 + i * 7919} or {i % 900 + 100}.{i % 300 + 300}.{i % 700 + 100}",
    }
    hidden = {
        "email": lambda i: ("mail ", f"joe{i} [at] home{i}.org"),
        "card": lambda i: ("paid by card ", four(luhn_number(rng), ".")),
        "ip": lambda i: ("from host ", "[.]".join(ip())),
        "phone": lambda i: ("or call ", f"(415) 555-{2000 + i}"),
    }
    disguised = {}
    for i in range(len(texts)):
        kind, turn = pii.KINDS[i % 4], i // 4 % 10
        words = texts[i].split(" ")
        at = rng.randrange(len(words) + 1)
        lead, put = hidden[kind](i) if turn == 9 else ("", (plain if turn < 5 else hard)[kind](i))
        start = len(" ".join(words[:at])) + (1 if at else 0) + len(lead)
        texts[i] = " ".join([*words[:at], lead + put, *words[at:]])
        if turn == 9:
            disguised[i] = f"{kind}:{start}:{start + len(put)}"
    return texts, disguised


def test_trees_decide_in_real_texts(spark, monkeypatch):
    """In texts of sf0.01 the trees find disguised spans and leave hard numbers; without them nothing is found; no feature of the format alone gives the labels."""
    texts, disguised = planted_texts(random.Random(9))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: set(filter(None, r.added.split(","))) for r in pii.find_personal_data(docs).collect()}
    hits = sum(want in added[i] for i, want in disguised.items())
    total = sum(map(len, added.values()))
    print("recall", hits / len(disguised), "precision", hits / max(1, total))
    assert len(disguised) == 100 and hits >= 85 and total - hits <= 5
    kept = []
    monkeypatch.setattr(pii, "_models", lambda candidates: kept.append(candidates) or {})
    assert not any(r.added for r in pii.find_personal_data(docs).collect())
    rows = kept[0].where("label is not null").groupBy("kind", "label", *pii.FEATURES).count().collect()
    for kind in pii.KINDS:
        own = [r for r in rows if r.kind == kind]
        for f in ("digits", "groups", "widest", "dots", "hyphens", "blanks", "parens"):
            sides = collections.defaultdict(collections.Counter)
            for r in own:
                sides[r[f]][r.label] += r["count"]
            assert sum(max(c.values()) for c in sides.values()) < sum(r["count"] for r in own), (kind, f)


def test_texts_of_many_numbers(spark):
    text = " ".join(str(i * 7919 % 100_000) for i in range(60_000))
    began = time.time()
    rows = pii.find_personal_data(spark.createDataFrame([(1, text), (2, "a@b.co " * 20_000)], "doc_id long, text string")).collect()
    assert time.time() - began < 240
    by = {r.doc_id: r for r in rows}
    want = base_spans(text)
    assert by[2].n_email == 20_000 and by[1].n_card == sum(s[2] == "card" for s in want)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
    assert by[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
