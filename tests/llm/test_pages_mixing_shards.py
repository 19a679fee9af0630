import html
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest

from pressmill.llm import mixing, sharding
from pressmill.llm.html_text import extract_main_text, main_text

DATA = "/root/testdata/sf0.01"


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain text", "plain text"),
        ("<body><div><p>One, two, three and more words here.</p><p>Second &amp; last.</p></div><div class='comments'><p>A reader, who comments, at length, here.</p></div></body>", "One, two, three and more words here.\nSecond & last."),
        ("<article><h2>T</h2><p>A<br>b&nbsp;c <i>d</i>e<form>f</form><ul><li>g<li>h</ul></article><footer>x</footer>", "T\nA b c de\ng\nh"),
        ("<div id='cookie-notice'><p>We, use, cookies, a, lot, of, them.</p></div><main><p>Text</p></main><aside>s</aside>", "Text"),
        ("<!-- <p>no</p> --><script>var a='<p>no</p>'</script><article><p>yes</article>", "yes"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_page_cases(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("n", [1, 3, 12, 40])
@pytest.mark.parametrize(
    ("page", "before", "after"),
    [
        ("<article><h1>Head</h1><div class=body>{0}</div><p>Closing words</p></article>", "Head", ["Closing words"]),
        ("<main><article><h1>Head</h1><section>{0}</section><section><p>Short part</p></section></article><p><a href=a>Source</a></p></main>", "Head", ["Short part", "Source"]),
        ("<body><div><h1>Head</h1><div><div>{0}</div></div><p>Closing words, to the end.</p></div></body>", "Head", ["Closing words, to the end."]),
        ("<div><h2>Head</h2><div>{0}</div>Loose words stay with <i>their</i> text.<ul><li>item</ul></div>", "Head", ["Loose words stay with their text.", "item"]),
        ("<main>Loose head <b>words</b><div>{0}</div><br>and a tail</main>", "Loose head words", ["and a tail"]),
    ],
)
def test_page_keeps_text_beside_the_body(page, before, after, n):
    block = "Words of a plain paragraph, of some length, that reads on. " * 3
    assert main_text(page.format(f"<p>{block}</p>" * n)).split("\n") == [before, *[block.strip()] * n, *after]


def test_page_drops_links_beside_the_body():
    block = "<p>" + "Words of a plain paragraph, of some length, that reads on. " * 3 + "</p>"
    links = "<ul><li><a href=a>Other one</a><li><a href=b>Other two</a></ul>"
    for page in ("<body><div><h1>Head</h1><div>{0}</div><h2>More</h2>{1}</div></body>", "<main><h1>Head</h1><div>{0}</div><h2>More</h2>{1}</main>"):
        got = main_text(page.format(block * 20, links)).split("\n")
        assert got[0] == "Head" and len(got) == 21


BLOCK = "Words of a plain paragraph, of some length, that reads on and on until its end. " * 3
PARA, LINE = f"<p>{BLOCK}</p>", BLOCK.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form action=x><input name=a><div><h1>Head</h1>{PARA * 3}</div><button>Go</button></form></body>", ["Head", LINE, LINE, LINE]),
        (f"<body><div class='post widget'><h1>Head</h1>{PARA * 3}</div><div class=widget><p>Buy, this, now, today.</p></div></body>", ["Head", LINE, LINE, LINE]),
        (
            f"<article><h1>Head</h1>{PARA}<div class=share-price><p>The price rose by two percent.</p></div><div class=related-work>{PARA}</div><div class=public-notice><p>Notice is given hereby.</p></div>"
            f"<div class=promo-code-explainer>{PARA}</div><div class=share-buttons><p>Share it.</p></div></article>",
            ["Head", LINE, "The price rose by two percent.", LINE, "Notice is given hereby.", LINE],
        ),
        (f"<body><article><h1>One</h1>{PARA * 2}</article><article><h1>Two</h1>{PARA * 2}</article><article><a href=x>More</a></article></body>", ["One", LINE, LINE, "Two", LINE, LINE]),
        (f"<article><h1>Head</h1>{PARA * 2}<div class=replies><p>I, for one, disagree with all of it.</p></div></article><section class='discussion'><p>Me, too, and my dog.</p></section>", ["Head", LINE, LINE]),
        (f"<main><h1>Head</h1>{PARA * 2}<ul class=x><li class=c><b class=author>Ann</b><p>I, for one, disagree.</p><li class=c><b class=author>Bob</b><p>So, do, I. Really.</p></ul></main>", ["Head", LINE, LINE]),
        (f"<body><div id=cookie-notice>{PARA * 3}</div><div><h1>Head</h1>{PARA}</div></body>", ["Head", LINE]),
        (f"<article>{PARA}</article><div class=comments>{PARA * 9}</div>", [LINE]),
        (f"<article><h1>Head</h1><div class=entry><time>1</time>{PARA}</div><div class=entry><time>2</time>{PARA}</div></article>", ["Head", "1", LINE, "2", LINE]),
        (f"<body><div class=related-posts><ul><li><a href=a>A</a></ul></div><div class=sidebar-left>{PARA}</div><div><h2>Head</h2>{PARA * 4}</div></body>", ["Head", LINE, LINE, LINE, LINE]),
        (f"<body><form><div class=newsletter-box><p>Join, now, and win.</p></div><main>{PARA}</main></form></body>", [LINE]),
        (f"<body><main>{PARA}<form><p>Your name, please.</p></form></main><form><p>Search, here.</p></form></body>", [LINE]),
    ],
)
def test_suspects_go_unless_they_hold_the_text(page, want):
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000 + "x", ("<b><p>" + "</i></q>") * 10_000 + "x", ("<div><li><b>x</i>") * 10_000, "<ul>" + "<li><b>x" * 20_000])
def test_stray_tags_cost_one_look_each(page):
    began = time.process_time()
    assert main_text(page)
    assert time.process_time() - began < 10


def test_page_frames(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x</p>"), (1, None)], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in extract_main_text(df).collect()) == [(0, "x"), (1, ""), (1, ""), (2, "")]
    assert extract_main_text(df.limit(0)).count() == 0


def targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        room = total - sum(fixed.values())
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(rows, sources):
    sizes, taken = Counter(), Counter()
    for r, s in zip(rows, sources):
        sizes[s] += r.size
        taken[s] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = targets(sizes)
    largest = defaultdict(int)
    for r, s in zip(rows, sources):
        largest[s] = max(largest[s], r.size)
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_mixing_meets_targets(spark, documents):
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), documents.dropDuplicates(["doc_id"])):
        rows = sorted(mixing.mix_sources(docs).collect(), key=lambda r: r.doc_id or -1)
        again = sorted(mixing.mix_sources(docs.repartition(7)).collect(), key=lambda r: r.doc_id or -1)
        assert rows == again
        source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
        check_mix(rows, [source[r.doc_id] for r in rows])
    assert mixing.mix_sources(documents.limit(0)).count() == 0


def test_mixed_documents_repeat_rows(spark, documents):
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    want = {(r.doc_id): r.copies for r in mixing.mix_sources(documents.dropDuplicates(["doc_id"])).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_documents(documents.dropDuplicates(["doc_id"])).select("doc_id").collect())
    assert {k: v for k, v in want.items() if v} == dict(got)


@pytest.mark.parametrize(("name", "sql", "run"), [("mix", mixing.ORACLE_SQL, lambda d: mixing.mix_sources(d).select("doc_id", "taken")), ("shard", sharding.ORACLE_SQL, lambda d: sharding.assign_shards(d, shard_bytes=sharding.QUERY_BYTES).select("doc_id", "shard"))])
def test_sql_oracles(spark, name, sql, run):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    column = {"mix": "taken", "shard": "shard"}[name]
    assert sorted(map(tuple, run(spark.read.parquet(f"{DATA}/documents.parquet")).collect())) == sorted(con.execute(f"select doc_id, {column} from ({sql})").fetchall())


@pytest.mark.parametrize("limit", [1, 3_000, 50_000])
def test_shards_fit(spark, limit):
    rows = sharding.assign_shards(spark.read.parquet(f"{DATA}/documents.parquet"), shard_bytes=limit).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
        assert r.depth == len(r.shard.split(".")[0])
    bits = {s for s in held}
    for shard, own in held.items():
        total = sum(r.n_bytes for r in own)
        assert total <= limit or len(own) == 1
        if shard and "." not in shard:  # its parent had to split
            assert sum(r.n_bytes for s in bits if s.startswith(shard[:-1]) for r in held[s]) > limit


def test_shards_of_repeats(spark, documents):
    rows = [(1, "x" * 10)] * 25 + [(None, "y" * 10)] * 5 + [(2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = Counter()
    for r in sharding.assign_shards(df, shard_bytes=30).collect():
        held[r.shard] += r.n_bytes
    assert max(held.values()) <= 30 and sum(held.values()) == 300
    assert sharding.assign_shards(documents).count() == documents.count() and sharding.assign_shards(documents.limit(0)).count() == 0


def test_mixing_odds_follow_sizes(spark):
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 100)), "abc"[i % 3]) for i in range(900)] + [(1000 + i, "w " * 4000, "c") for i in range(2)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in rows}
    own = [r for r in got if source[r.doc_id] == "c"]
    more, left = [r for r in own if r.copies == 1], [r for r in own if r.copies == 0]
    assert max(r.rank for r in more) <= min(r.rank for r in left)  # the rank decides
    share = {s: sum(r.copies for r in own if r.size == s) / sum(r.size == s for r in own) for s in (10, 100, 4000)}
    assert share[100] > 2 * share[10]  # simple random sampling would take both alike
    assert share[4000] == 1 and all(r.rank == 0 for r in own if r.size == 4000)  # certain


def test_mixing_null_ids_spread(spark):
    rows = [(None, f"w{i} " * (1 + i % 7), "a") for i in range(900)] + [(i, "x " * 20, "b") for i in range(60)] + [(100 + i, "x " * 9, "c") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len({r.rank for r in got if r.doc_id is None}) > 100
    check_mix(got, ["a" if r.doc_id is None else "b" if r.doc_id < 100 else "c" for r in got])
