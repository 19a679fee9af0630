"""Feed files, the store and the stream."""

from pyspark.sql import functions as F

from pressmill.operators import dedupe
from pressmill.plans import dims
from pressmill.sources import rss
from pressmill.sources.store import Store
from pressmill.streaming.merge import start_merge

FEED = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/"><channel>
<item><title>Election &amp; vote</title><link>https://x.ca/1</link><pubDate>Fri, 20 Mar 2026 18:40:00 GMT</pubDate>
<description>&lt;p&gt;Toronto text&lt;/p&gt;</description><media:content url="https://i/1.jpg" type="image/jpeg" width="10" height="10"/>
<media:content url="https://i/2.jpg" type="image/jpeg" width="20" height="10"/></item>
<item><title>No link</title></item>
<item><link>https://x.ca/2</link><media:content url="https://i/3.jpg" medium="image"/></item></channel></rss>"""


def test_rss_items(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    items = rss.read_items(spark, str(tmp_path / "feed.xml")).withColumn("registry_key", F.lit("national_cbc_top")).withColumn("entry_pos", F.monotonically_increasing_id())
    rows = sorted(rss.to_articles(items, dims.sources(spark), F.lit("2026-03-21 00:00:00").cast("timestamp")).collect(), key=lambda r: r.link)
    assert [r.title for r in rows] == ["Election & vote", "https://x.ca/2"]
    assert rows[0].image_url == "https://i/2.jpg" and rows[0].region == "Toronto" and rows[0].topic == "Politics" and rows[0].source == "CBC News"
    assert str(rows[0].published_ts) == "2026-03-20 18:40:00" and str(rows[1].published_ts) == "2026-03-21 00:00:00"


def _articles(spark, ids):
    rows = [(i, f"http://a/{i % 7}", f"t{i % 5}", "s", "") for i in ids]
    return spark.createDataFrame(rows, "pos long, link string, title string, source string, published_text string")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    keyed = dedupe.with_keys(_articles(spark, range(3)))
    store.replace(keyed)
    counts = {r.reason: r.n for r in store.merge(dedupe.with_keys(_articles(spark, range(10)))).collect()}
    assert sum(counts.values()) == 10 and store.read("news").count() == 3 + counts["new"]
    local = keyed.select("pos", "title")
    store.replace_scope(local, "Toronto", "Ontario")
    store.replace_scope(local, "Ottawa", "Ontario")
    store.replace_scope(local.limit(1), "Toronto", "Ontario")
    assert store.read_scope("Toronto", "Ontario").count() == 1 and store.read_scope("Ottawa", "Ontario").count() == 3
    news = spark.createDataFrame([(1, "old", "pending"), (2, "kept", "ready")], "id int, summary string, summary_status string")
    for k, word in enumerate(("first", "last")):
        store.update_summaries(spark.createDataFrame([(1, word, "ready", k)], "id int, summary string, summary_status string, updated_at int"))
    assert {r.id: r.summary for r in store.with_summaries(news).collect()} == {1: "last", 2: "kept"}


def test_stream_equals_batch(spark, tmp_path):
    store, inbox = Store(spark, str(tmp_path / "store")), str(tmp_path / "inbox")
    schema = _articles(spark, [0]).schema
    for part in (range(0, 8), range(8, 20), range(0, 8)):
        _articles(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        start_merge(stream, store, str(tmp_path / "checkpoint"), None).awaitTermination(120)
    once = dedupe.dedupe_greedy(dedupe.with_keys(_articles(spark, range(20)))).where("kept")
    assert {(r.link_key, r.content_key) for r in store.read("news").collect()} == {(r.link_key, r.content_key) for r in once.collect()}
    assert store.read("news").groupBy("link_key").count().where("count > 1").count() == 0


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>It&amp;#8217;s on</title><link rel="alternate" href="https://x.ca/a?b=1&amp;c=2"/>
<updated>2026-03-20T18:40:00Z</updated><content type="html">&lt;p&gt;Regina caf&amp;eacute;&lt;/p&gt;</content></entry><entry><title>No link</title></entry><entry><title>broken</tittle></entry></feed>"""


def test_items_of_bodies(spark):
    bodies = spark.createDataFrame([("national_cbc_top", FEED, 1), ("national_global_top", ATOM, 2), ("national_global_top", None, 3), ("national_global_top", "no feed", 4)], "registry_key string, body string, feed int")
    items = rss.items_of(bodies)
    assert sorted((r.feed, r.entry_pos) for r in items.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    rows = sorted(rss.to_articles(items, dims.sources(spark), F.lit("2026-03-21 00:00:00").cast("timestamp")).collect(), key=lambda r: r.link)
    assert [(r.link, r.title) for r in rows] == [("https://x.ca/1", "Election & vote"), ("https://x.ca/2", "https://x.ca/2"), ("https://x.ca/a?b=1&c=2", "It&#8217;s on")]
    assert rows[0].image_url == "https://i/2.jpg" and rows[2].excerpt == "Regina café" and rows[2].region == "Regina" and str(rows[2].published_ts) == "2026-03-20 18:40:00"


def test_ingest_small_batch(spark, tmp_path):
    """The whole way: duplicates and foreign stories out, reports of one story merged, ranked, stored once."""
    from pressmill.operators import ingest

    story = "Council passes the budget after a long debate on transit"
    rows = [
        (1, story, "https://cbc.ca/1?utm_source=a", "CBC - Ottawa", "p1", "2026-03-20 10:00:00", "Ottawa", "https://i.ca/1.jpg"),
        (2, story, "https://cbc.ca/1", "CBC - Ottawa", "p2", "2026-03-20 11:00:00", "Ottawa", None),
        (3, story + " plan", "https://globalnews.ca/2", "Global News", "p3", "2026-03-20 12:00:00", "Ottawa", "https://i.ca/1.jpg"),
        (4, "Goat wins the county race again this year", "https://bbc.com/3", "BBC", "p4", "2026-03-20 13:00:00", "World", None),
        (5, "Goat wins the county race again this year", "https://x.ca/4", "X", "p5", "2026-03-20 09:00:00", "", None),
    ]
    df = spark.createDataFrame(rows, "pos long, title string, link string, source string, published_text string, published string, region string, image_url string")
    df = df.withColumn("published_ts", F.col("published").cast("timestamp_ntz")).drop("published")
    df = df.withColumns({"excerpt": F.lit(""), "topic": F.lit(""), "category": F.lit(""), "coverage_level": F.lit(""), "coverage_city": F.lit(""), "coverage_province": F.lit(""), "registry_key": F.lit("k")})
    as_of = F.lit("2026-03-20 14:00:00").cast("timestamp_ntz")
    stories, report = ingest.ingest(df, as_of)
    assert report.first().asDict() == {"raw_entries": 5, "skipped_duplicate_link": 1, "skipped_duplicate_content": 0, "after_dedupe": 4, "after_home_filter": 3, "filtered_not_home": 1, "candidates": 3}
    got = sorted(stories.collect(), key=lambda r: -r.rank_score)
    assert [(r.pos, r.trending_score, r.sources) for r in got] == [(3, 2, ["CBC Ottawa", "Global News"]), (5, 1, ["X"])]
    assert got[0].summary == story + " plan." and got[0].rank_score > got[1].rank_score and got[0].link == "https://globalnews.ca/2"
    assert ingest.ingest(df.limit(0), as_of)[0].count() == 0


def test_refresh_modes(spark, tmp_path):
    """An empty store, one that is served, a place without rows, with fresh and with old ones, and forced requests; readers keep their version."""
    from pressmill.operators import ingest

    store, ts = Store(spark, str(tmp_path)), lambda t: F.lit(f"2026-03-20 {t}").cast("timestamp_ntz")
    make = lambda n, at="14:00:00": lambda place: dedupe.with_keys(_articles(spark, range(n))).withColumn("last_updated_at", ts(at))
    place = ("Ottawa", "Ontario")
    n_rows = lambda: (store.read("news").count(), store.read_scope(*place).count())
    assert ingest.refresh(store, make(2), ts("14:00:00")) == "cold_start_general"
    assert ingest.refresh(store, make(3), ts("14:00:00")) == "read" and store.version() == 1
    old = store.read("news")
    assert ingest.refresh(store, make(1), ts("14:00:00"), place) == "stale_local" and n_rows() == (2, 1)
    assert ingest.refresh(store, make(3), ts("14:14:59"), place) == "read"
    assert ingest.refresh(store, make(2), ts("14:15:00"), place) == "stale_local" and n_rows() == (2, 2)
    assert ingest.refresh(store, make(3), ts("14:00:00"), place, True) == "ingest_local" and n_rows() == (2, 3)
    assert ingest.refresh(store, make(4), ts("14:00:00"), forced=True) == "ingest_general" and n_rows() == (4, 3)
    assert old.count() == store.read("news", 1).count() == 2
    assert ingest.refresh(Store(spark, str(tmp_path / "new")), make(2), ts("14:00:00"), place) == "stale_local"


def test_merge_ingest(spark, tmp_path):
    """A whole ingest merged beside stories stored without keys."""
    from pressmill.operators import ingest

    titles = ("Council passes the budget", "Goat wins the county race", "Storm closes the harbour bridge")
    rows = [(k, t, f"https://cbc.ca/{k}", "CBC", f"p{k}", f"2026-03-20 1{k}:00:00", "Ottawa") for k, t in enumerate(titles)]
    items = spark.createDataFrame(rows, "pos long, title string, link string, source string, published_text string, published string, region string")
    store = Store(spark, str(tmp_path))
    store.replace(items.where("pos < 2").select("pos", "title", "link", "source", "published_text"))
    store.index()
    items = items.withColumn("published_ts", F.col("published").cast("timestamp_ntz")).drop("published")
    items = items.withColumns({c: F.lit("") for c in ("excerpt", "topic", "category", "coverage_level", "coverage_city", "coverage_province", "image_url")} | {"registry_key": F.lit("k")})
    counts = {r.reason: r.n for r in ingest.merge_ingest(items, store, F.lit("2026-03-20 14:00:00").cast("timestamp_ntz")).collect()}
    assert counts == {"stored_link": 2, "new": 1} and store.read("news").count() == 3


def test_lookup_opens_few_buckets_however_large_the_store(spark, tmp_path):
    """A fixed batch of new keys and some stored ones, against stores of two sizes."""
    from pressmill.sources.keys import KeyLayout

    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("https://a.ca/"), "id").alias("link_key"), F.md5(F.col("id").cast("string")).alias("content_key"))
    asked = spark.range(10**6, 10**6 + 40).select(F.concat(F.lit("l:https://a.ca/"), "id").alias("key")).unionByName(spark.createDataFrame([("l:https://a.ca/7",), ("l:https://a.ca/8",)], "key string"))
    opened = []
    for n in (300, 3000):
        store = Store(spark, str(tmp_path / str(n)), KeyLayout(32, 1))
        store.append(rows(0, n))
        found = store.look_up(asked)
        assert sorted(r.key for r in found.known.collect()) == ["l:https://a.ca/7", "l:https://a.ca/8"]
        opened.append((found.buckets_opened, found.files_opened))
    assert opened[0] == opened[1] and opened[0][0] <= 2


def test_compaction_and_layouts(spark, tmp_path):
    import pytest

    from pressmill.sources.keys import KeyLayout

    store = Store(spark, str(tmp_path), KeyLayout(4, 1))
    for k in range(3):
        store.merge(dedupe.with_keys(_articles(spark, range(4 * k, 4 * k + 5))), batch_id=k)
    store.merge(dedupe.with_keys(_articles(spark, range(100))), batch_id=2)  # run again: adds nothing
    before = sorted(map(tuple, store.read("news").collect()))
    assert len([e for e in store.entries() if e.name == "news"]) == 3
    store.compact()
    assert len([e for e in store.entries() if e.name == "news"]) == 1 and sorted(map(tuple, store.read("news").collect())) == before
    assert store.batches() == {2}
    stored = {"stored_link", "stored_content"}
    assert {r.reason for r in store.merge(dedupe.with_keys(_articles(spark, range(7)))).collect()} <= stored
    other = Store(spark, str(tmp_path), KeyLayout(8, 1))
    with pytest.raises(ValueError):
        other.merge(dedupe.with_keys(_articles(spark, range(7))))
    other.index()
    assert {r.reason for r in other.merge(dedupe.with_keys(_articles(spark, range(7)))).collect()} <= stored


def test_snapshot_is_made_once_a_version(spark, tmp_path):
    from datetime import datetime, timedelta

    store, calls, now = Store(spark, str(tmp_path)), [], datetime(2026, 3, 20, 14, 0)
    make = lambda df: (calls.append(1), df.agg(F.count("*").alias("n")))[1]
    read = lambda at: store.snapshot("n", "news", make, at, 120).first().n
    store.append(_articles(spark, range(3)))
    assert (read(now), read(now + timedelta(seconds=119)), len(calls)) == (3, 3, 1)
    assert read(now + timedelta(seconds=121)) == 3 and len(calls) == 2
    store.append(_articles(spark, range(2)))
    assert read(now + timedelta(seconds=122)) == 5 and len(calls) == 3


def test_affinity_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from pressmill.operators import readers
    from pressmill.streaming.merge import affinity_state, start_affinity

    schema = "user_id long, category string, kind string"
    parts = [[(1, "Sports", "open"), (1, "sports ", "save"), (2, "Arts", "search")], [(1, "Sports", "open")] * 9, [(2, "Arts", "open"), (3, None, "open"), (3, "Law", "none")]]
    store = Store(spark, str(tmp_path / "store"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
        start_affinity(spark.readStream.schema(schema).parquet(str(tmp_path / "inbox")), store, str(tmp_path / "checkpoint"), None).awaitTermination(120)
    want = readers.affinity(spark.createDataFrame([r for p in parts for r in p], schema))
    assert sorted(map(tuple, affinity_state(store).collect())) == sorted(map(tuple, want.collect()))


def test_feed_source_in_batch_and_rounds(spark, tmp_path):
    """Each feed is a row, a missing one and a silent one too; a restarted stream fetches its next round."""
    import json
    import socket

    from pressmill.sources.fetch import FeedSource

    (tmp_path / "a.xml").write_text(FEED)
    with socket.socket() as silent:
        silent.bind(("127.0.0.1", 0))
        silent.listen()
        feeds = [("a", f"file://{tmp_path}/a.xml"), ("gone", f"file://{tmp_path}/gone.xml"), ("silent", f"http://127.0.0.1:{silent.getsockname()[1]}/")]
        spark.dataSource.register(FeedSource)
        load = lambda reader, **more: reader.format("feeds").options(feeds=json.dumps(feeds), timeout="1", **more).load()
        rows = {r.registry_key: r for r in load(spark.read).collect()}
        assert rows["a"].ok and rows["a"].body == FEED and rows["a"].stage == "done"
        assert not rows["gone"].ok and not rows["silent"].ok and "timed out" in rows["silent"].error and rows["gone"].body is None
        for n in (1, 2):
            rounds = load(spark.readStream, every="0.01").drop("elapsed_ms").writeStream.format("parquet")
            rounds.option("path", str(tmp_path / "got")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination(120)
            assert spark.read.parquet(str(tmp_path / "got")).groupBy("registry_key").count().where(f"count = {n}").count() == 3
    assert spark.read.format("feeds").load().count() == 0
