import pytest
from pyspark.sql import functions as F

from pressmill.functions import media, text, wording
from pressmill.operators import cluster, feed, rank


def values(spark, fn, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    cols = [F.col(c) for c in df.columns[1:]]
    return [r.v for r in df.select("i", fn(*cols).alias("v")).orderBy("i").collect()]


def test_clean_summary(spark):
    long_ = " ".join(f"word{i}" for i in range(70))
    got = values(spark, wording.clean_summary, "A one. B two! C three? D four.", "Read more: here. Click here", f"Short one. {long_}.", f"{long_[:60]}. {long_}", None, "ends..", "no stop")
    assert got[0] == "A one. B two! C three?"
    assert got[1] == "here."
    assert got[2] == "Short one. " + " ".join(f"word{i}" for i in range(53)) + "."
    assert len(got[3].split()) <= 55
    assert got[4:] == ["", "ends…", "no stop."]


def test_vague_ends(spark):
    got = values(
        spark, wording.without_vague_end, "Police held two men. More details to come.", "Stay tuned. It rained all day.", "Fire in town. Further updates are expected soon by all. This is a developing story.", "Stay tuned.", "So it is. Tuned."
    )
    assert got == ["Police held two men.", "Stay tuned. It rained all day.", "Fire in town.", "Stay tuned.", "So it is. Tuned."]


def test_title_summary(spark):
    cases = {
        "Ottawa council votes: budget passes after debate": "Ottawa council votes. Budget passes after debate.",
        "Short: budget passes – after a long debate": "Short: budget passes. After a long debate.",
        "Toronto Maple Leafs down Boston Bruins in OT": "The Toronto Maple Leafs beat the Boston Bruins in overtime.",
        "Montreal Canadiens down Ottawa Senators": "The Montreal Canadiens beat the Ottawa Senators.",
        "Oil prices down 5 percent": "Oil prices down 5 percent.",
        "Regina Police Service welcomes new electronic storage detection dog": "Regina police have introduced a new dog trained to detect electronic storage devices.",
        "Regina Police Service welcomes new chief.": "Regina police have introduced a new chief.",
        "ICE detains B.C. mom, daughter in Texas amid bumpy road to citizenship": "A B.C. mother and daughter were detained by ICE in Texas during a complicated citizenship process.",
        "ICE detains three workers": "ICE detained three workers.",
        "mayor hopes to win, says aide": "Mayor plans to win.",
        "Storm reportedly hits the coast , , amid fear": "Storm hits the coast, during fear.",
        "": "News update.",
        "éclair day!": "Éclair day!",
    }
    assert values(spark, wording.title_summary, *cases) == list(cases.values())


def test_redundancy(spark):
    title = "Storm hits northern coast on Monday night"
    df = spark.createDataFrame(
        [(title, title), (f"{title} again", title), ("Storm hits coast Monday night", title), ("Crews cleared the roads by noon", title), ("", title), (title, "")], "s string, t string"
    )
    rows = df.select(wording.is_redundant(F.col("s"), F.col("t"), wording.ratio(F.lower("s"), F.lower("t"))).alias("v")).collect()
    assert [r.v for r in rows] == [True, True, True, False, False, False]


def test_checked_summary(spark):
    excerpt = "Crews cleared the roads by noon on Tuesday after the storm. Schools will open again on Wednesday morning, officials said."
    rows = [
        ("The mayor resigned today. A vote comes in June.", "Mayor quits", excerpt),  # good as it is
        ("Mayor quits. Stay tuned for more details to come.", "Mayor quits", None),  # filler out, then from the title
        ("The mayor of the town resigned today after a vote.", "Mayor quits", excerpt),  # one sentence: another from the excerpt
        ("", "Council votes again: budget passes at last", None),
        ("Storm hits northern coast on Monday night. Storm hits northern coast.", "Storm hits northern coast on Monday night", excerpt),  # echo
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, summary string, title string, excerpt string")
    got = [r.checked for r in wording.checked_summary(df, "summary", "title", "excerpt").orderBy("i").collect()]
    from_excerpt = "Crews cleared the roads by noon on Tuesday after the storm. Schools will open again on Wednesday morning, officials said."
    assert got[0] == rows[0][0]
    assert got[1] == "Mayor quits."
    assert got[2] == "The mayor of the town resigned today after a vote. Crews cleared the roads by noon on Tuesday after the storm."
    assert got[3] == "Council votes again. Budget passes at last."
    assert got[4] == from_excerpt


def test_enriched_excerpt(spark):
    rows = [("x" * 90, "Title here", "CBC", ""), ("short", "T", "Google News — Canada", "A description"), ("short", "T", "CBC", "A description"), (None, "T", "CBC", "")]
    assert values(spark, wording.enriched_excerpt, *rows) == ["x" * 90, "A description", "short", None]


def test_references_decoded(spark):
    got = values(spark, text.plain, "It&#8217;s caf&eacute; &amp;lt;b&amp;gt; &#x1F600; &nope; &#150; a&nbsp;b", "<p>x</p><script>y</script> z", None)
    assert got == ["It’s café <b> 😀 &nope; – a b", "x z", ""]


@pytest.mark.parametrize(
    ("j", "r", "inside"), [(0.25, 0.60, True), (0.20, 0.45, False), (0.71, 0.84, False), (0.45, 0.92, False), (0.05, 0.53, True), (0.30, 0.48, True), (0.21, 0.30, False), (0.65, 0.89, True), (0.90, 0.80, True)]
)
def test_embedding_band(spark, j, r, inside):
    assert spark.range(1).select(cluster.embedding_band(F.lit(j), F.lit(r)).alias("v")).first().v is inside


def test_embedding_edges_reach_pairs_by_ratio_alone(spark):
    rows = [(1, "premier resigns after vote", [1.0, 0.0, 0.2]), (2, "premiers resigned over votes", [1.0, 0.05, 0.2]), (3, "goat wins race", [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, t, "", f"http://a.ca/{i}", "", v) for i, t, v in rows], "pos long, title string, excerpt string, link string, topic string, embedding array<double>")
    none = spark.createDataFrame([], "node long, component long")
    got = cluster.embedding_edges(cluster.prepare(df), df, none).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_near_vectors_recall(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base + 0.45 * rng.standard_normal(base.shape), np.zeros((1, 32))])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cos = unit @ unit.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= 0.88}
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None)], "pos long, embedding array<double>")
    got = {(r.a, r.b) for r in cluster.near_vectors(df, 0.88).collect()}
    assert len(want) > 30 and got == want


def test_near_vectors_in_cells_and_blocks(spark, monkeypatch):
    """Many cells of several blocks, with copies: every near pair once, and none of unrelated vectors becomes a row."""
    import numpy as np

    monkeypatch.setattr(cluster, "CELL", 40)
    monkeypatch.setattr(cluster, "BLOCK", 16)
    monkeypatch.setattr(cluster, "PART", 3)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((80, 24))
    x = np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape), base[:10], np.tile(base[3], (8, 1))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if cos[i, j] >= 0.88}
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pos long, embedding array<double>")
    got = [(r.a, r.b) for r in cluster.near_vectors(df, 0.88).collect()]
    assert cluster._tables_of(len(base) * 2, 0.88)[0] > 5 and len(got) == len(set(got)) and set(got) == want
    few, many = cluster._tables_of(1_000_000, 0.88), cluster._tables_of(36_000_000, 0.88)
    assert many[0] < 3 * few[0] and 36e6 / 2 ** many[1] <= 40


def test_location_boost_reasons(spark):
    of = lambda city, province: [tuple(r) for r in spark.createDataFrame([("Ottawa",), ("ontario",), ("Toronto",), ("Canada",), ("",), ("Regina",)], "region string").select(rank.location_boost(F.col("region"), city, province).alias("v")).select("v.*").collect()]
    assert of("ottawa", "Ontario") == [(92.0, "city_exact"), (50.0, "province_exact"), (50.0, "province_via_city"), (24.0, "national"), (0.0, "empty_region"), (0.0, "baseline")]
    assert of(None, " ") == [(0.0, "no_preference")] * 6


def test_client_filter_outlets(spark):
    rows = [(1, "A", "x", ["B"]), (2, "B", "y", []), (3, "B", "z", ["C", " A "])]
    df = spark.createDataFrame([(*r, None, "Cat") for r in rows], "id int, source string, title string, sources array<string>, topic string, category string")
    got = lambda **kw: sorted(r.id for r in feed.client_filter(df, **kw).collect())
    assert got(outlet="B") == [1, 2] and got(outlet="A") == [3] and got(topic="Cat") == [1, 2, 3] and got(term="cat z") == [] and got(term="CAT B") == [2, 3]


def test_greedy_dedupe_of_a_long_chain(spark):
    from pressmill.operators import dedupe

    n = 40  # each row shares its link with the one before and its content with the one after, in turn
    rows = [(i, f"l{(i + 1) // 2}", f"c{i // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "pos long, link_key string, content_key string")
    got = sorted(r.pos for r in dedupe.dedupe_greedy(df).where("kept").collect())
    links, contents, want = set(), set(), []
    for i, link, content in rows:
        if link not in links and content not in contents:
            want.append(i)
            links.add(link)
            contents.add(content)
    assert got == want


def test_pictures_and_videos(spark):
    html = '<img width="60" height="60" src="/tiny.png"><img data-lazy-src="a b.png">'
    got = spark.createDataFrame([(html, "<iframe src='https://www.youtube.com/embed/aa'>", "none"), (None, None, None)], "a string, b string, c string").select(
        media.page_picture(F.col("a"), F.lit("http://x.ca/y/z")).alias("p"), media.video_url(F.col("b")).alias("v"), media.video_url(F.col("c")).alias("n"), media.page_description(F.col("a"), F.lit("short")).alias("d")
    ).collect()
    assert got[0].p.kind == "html" and got[0].p.url == "http://x.ca/y/a b.png" and got[0].v == "https://www.youtube.com/embed/aa" and got[0].n is None and got[0].d == ""
    assert got[1].p is None and got[1].v is None
