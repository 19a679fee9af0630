"""Golden cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from pressmill.functions import dates, media, text, urls
from pressmill.operators import classify, cluster, feed, local, rank
from pressmill.plans import dims, feedplan


def values(spark, fn, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    cols = [F.col(c) for c in df.columns[1:]]
    return [r[1] for r in df.select("i", fn(*cols).alias("v")).orderBy("i").collect()]


def test_normalize_link(spark):
    assert values(
        spark, urls.normalize_link, "HTTP://A.com/X/?utm_source=a&b=1&fbclid=2#top", "https://a.com/x///", "/", "", None, " not a url ", "http://a.com?gclid=1"
    ) == ["http://a.com/x/?b=1", "https://a.com/x", "/", "", "", "not a url", "http://a.com"]


def test_other_link_keys(spark):
    links = ("HTTP://A.com/X/?q=1#f", "http://a.com")
    assert values(spark, urls.story_link, *links) == ["http://a.com/x/", "http://a.com/"]
    assert values(spark, urls.image_key, *links) == ["a.com/x", "http://a.com"]
    assert values(spark, urls.client_link, *links) == ["http://a.com/x/?q=1#f", "http://a.com"]


def test_hosts(spark):
    assert values(spark, urls.is_blocked_host, "https://www.bbc.com/x", "https://notbbc.com/x", "") == [True, False, False]
    assert values(spark, urls.is_home_host, "https://x.ca/1", "https://www.thestar.com/1", "https://a.com", "") == [True, True, False, False]


def test_titles(spark):
    assert values(spark, text.normalize_title, "  Montréal’s – “Big”  news-day! ", None) == ["montréals big news day", ""]
    assert values(spark, text.client_title, "Montréal’s – Big") == ["montrals big"]
    assert values(spark, text.story_title, "BREAKING: Live updates - The Storm!", "!!!", "Breakingham palace") == ["the storm", "untitled", "ham palace"]


def test_summaries(spark):
    assert values(spark, text.tidy_tail, "a...", "a.....", "a!?", "a", "") == ["a…", "a……", "a.", "a.", ""]
    long = "word " * 60
    (cut,) = values(spark, text.clamp, long)
    assert cut.endswith("word…") and len(cut) <= 221
    (solid,) = values(spark, text.clamp, "x" * 300)
    assert solid == "x" * 220 + "…"
    df = spark.createDataFrame([("T", "<p>One two three four five.</p> <p>Six seven eight nine ten eleven.</p>"), ("T", "short"), ("", None), ("T", "fifteen letters")], "t string, e string")
    got = [(r.made.summary, r.made.summary_source) for r in text.add_summary(df, "t", "e").collect()]
    assert got == [
        ("One two three four five. Six seven eight nine ten eleven.", "html"), ("T.", "title_fallback"), ("News update.", "title_fallback"), ("fifteen letters.", "rss")
    ]


def test_sentences_and_tokens(spark):
    assert values(spark, text.sentences, "A b. C d!  E?", "") == [["A b.", "C d!", "E?"], []]
    assert values(spark, text.tokens, "the storm a storm hits") == [["storm", "hits"]]
    assert len(text.STOPWORDS) == len(set(text.STOPWORDS))


def test_dates(spark):
    got = values(spark, lambda c: F.date_format(dates.parse_published(c), "yyyy-MM-dd HH:mm"), "Fri, 20 Mar 2026 18:40:00 +0200", "2026-03-20T18:40:00Z", "2026-03-20", "Mar 20, 2026 18:40", "Fri, 20 Mar 2026 18:40:00 GMT", "soon", None)
    assert got == ["2026-03-20 16:40", "2026-03-20 18:40", "2026-03-20 00:00", "2026-03-20 18:40", "2026-03-20 18:40", None, None]


def test_media(spark):
    assert values(spark, media.video_url, '<iframe src="https://www.youtube.com/embed/a1">', "x youtu.be/zz", "vimeo.com/12", '<video><source src="a.mp4"></video>', None) == [
        "https://www.youtube.com/embed/a1", "https://www.youtube.com/watch?v=zz", "https://vimeo.com/12", "a.mp4", None,
    ]
    assert values(spark, media.absolute_url, ("//a/b", ""), ("/x", "https://h/y/z"), ("x", "https://h/y/z?q"), ("", "https://h")) == ["https://a/b", "https://h/x", "https://h/y/x", ""]


def test_region_traps(spark):
    region = lambda t: classify.infer_region(t, F.lit(""))
    assert values(spark, region, "Toronto in Ontario", "The senator spoke", "Reginald", "Montréal", "Ontario", "Hello") == ["Toronto", "World", "Regina", "Montreal", "Ontario", "Canada"]
    whole = lambda t: classify.infer_region(t, F.lit(""), whole_words=True)
    assert values(spark, whole, "The senator spoke", "Reginald", "Iran talks") == ["Canada", "Canada", "World"]


def test_topics(spark):
    assert values(spark, classify.keyword_topic, "the election", "ot win", "total", "nba", "snbax", "mp speaks") == ["Politics", "Sports", "Other", "Sports", "Other", "Politics"]
    assert values(spark, classify.link_topic, "https://www.cbc.ca/news/politics/x", "https://globalnews.ca/money/1", "https://x.com/politics") == ["Politics", "Business", None]
    topic = lambda k, s, u, t: classify.assign_topic(k, s, u, t, F.lit(""), F.lit("national"))
    assert values(spark, topic, ("x_politics", "", "", ""), ("", "Global News - Health", "", ""), ("", "", "", "a murder"), ("", "", "", "zz")) == ["Politics", "Health", "Crime", "Canada"]


def test_followed(spark):
    assert values(spark, lambda c: F.array_join(classify.followed_topics(c), ","), "AI and rent", "said paid", "work  permit") == ["ai,housing", "", "immigration"]


def test_rank(spark):
    df = spark.sql("select timestamp_ntz'2026-01-01 00:00:00' as now, explode(array(timestamp_ntz'2026-01-01 00:00:00', timestamp_ntz'2025-12-31 22:00:00', timestamp_ntz'2025-12-31 21:59:00', timestamp_ntz'2026-01-02 00:00:00', null)) as t")
    got = [round(r[0], 3) for r in df.select(rank.recency(F.col("t"), F.col("now"))).collect()]
    assert got == [54.0, round(44 * math.exp(-2 / 30) + 10, 3), round(44 * math.exp(-(2 + 1 / 60) / 30), 3), 54.0, 9.0]
    assert values(spark, lambda c: rank.coverage(c.cast("int")), "0", "14", "15", None) == pytest.approx([3.2, 44.8, 44.8, 3.2])
    assert values(spark, rank.category, "Canada politics", "zz", None) == [18.0, 0.0, 0.0]


def test_local_tiers(spark):
    rows = [
        ("Toronto", "", "", "", 0), ("Ottawa", "", "", "", 4), ("Ontario", "", "", "", 2), ("Quebec", "", "", "", 4), ("Canada", "national", "", "", 3),
        ("", "city", "Toronto", "", 0), ("", "city", "Ottawa", "", 4), ("", "province", "", "Ontario", 2), ("", "", "", "", 4), ("Canada", "", "", "", 3), ("", "national", "", "", 3),
    ]
    tier = lambda *c: local.local_tier(*c, "Toronto", "Ontario")
    assert values(spark, tier, *[r[:4] for r in rows]) == [r[4] for r in rows]
    near = lambda *c: local.local_tier(*c, "Mississauga", "Ontario", "Toronto")
    assert values(spark, near, ("Toronto", "", "", ""), ("", "city", "Toronto", "")) == [1, 1]


def test_feed_plan(spark):
    sources = dims.sources(spark)
    assert sources.count() == 47 and feedplan.registry_stats(sources).first()[1:] == (46, 17)
    assert feedplan.feed_plan(sources, "Toronto", "Ontario").fallback_type() == "exact_city"
    assert feedplan.feed_plan(sources, "Brampton", "Ontario").fallback_type() == "metro_fallback"
    assert feedplan.feed_plan(sources, "Sudbury", "Ontario").fallback_type() == "province_fallback"
    assert feedplan.feed_plan(sources, "Iqaluit", "Nunavut").fallback_type() == "national_only"
    assert feedplan.feed_plan(sources, "Kelowna", "British Columbia", True).fallback_type() == "exact_city"
    assert feedplan.hub_for("Toronto") is None and feedplan.hub_for("Richmond Hill") == "Toronto" and feedplan.hub_for(None) is None


def test_paging():
    assert feed.page_bounds(0, 0) == (0, 5) and feed.page_bounds(3, 6) == (10, 5) and feed.page_bounds(2, 3) == (3, 3)
    assert feed.page_count(11, 5) == 3 and feed.page_count(0, 5) == 0


def test_containment(spark):
    pair = lambda a, b: cluster.contains_title(a, b)
    base = "abcdefghijklmnopqr"
    assert values(spark, pair, (base, base + "x"), (base[:17], base), (base, base + "y" * 30), ("", "")) == [True, False, False, False]


def test_link_queries_are_written_anew(spark):
    """Against the standard library's reading and writing of queries, on odd escapes."""
    from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

    from pressmill.functions import urls

    def plain(u):
        p = urlparse(u.strip())
        kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in urls.TRACKING]
        return urlunparse((p.scheme, p.netloc.lower(), p.path, p.params, urlencode(kept), "")).lower()

    queries = ["", "a", "a=", "=b", "a=b=c", "a=1&&b=2", "utm_x=1", "UTM_Source=1&b=%", "%75tm_a=1&c=%zz", "q=a+b%20c", "q=%C3%A9é", "x=%C3%28", "x=%E2%82&y=%ff", "x=~*!'()-._", "gclid=1&gclidx=2", "a%3Db=c%26d", "x=日本 語", "x=%2525", "x=100%&y", "t=a%00b", "x=/?:@"]
    rows = [f"HTTPS://X.ca/P;v=1?{q}#frag" for q in queries] + ["https://x.ca", "https://x.ca/a?"]
    got = spark.createDataFrame([(u,) for u in rows], "u string").select("u", urls.normalize_link(F.col("u")).alias("n")).collect()
    assert [(r.u, r.n) for r in got] == [(u, plain(u)) for u in rows]


def test_a_reference_is_searched_among_few():
    import json

    lists = json.loads(text._references())
    assert sum(map(len, lists.values())) > 2000 and max(len(lists), *map(len, lists.values())) <= 250
