"""Queries on feed files, the store, the stream, labels by the real rules and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, media, naming, text, urls
from ..operators import classify, cluster, dedupe, feed, ingest, readers, views
from ..plans import dims, feedplan
from ..sources import rss
from ..sources.store import Store, fill_pending, scratch
from ..streaming.merge import start_merge
from .newsroom import dealt, dealt_sql
from .tables import table

REGION_WORDS = tuple((label, word) for label, words in classify.REGION_RULES for word in (words[0], words[-1]))
# What decides a topic, as (feed key, feed name, link, title, level, topic): key, name, path of each site, words, level.
TOPIC_CASES = (
    ("national_global_politics", "x", "https://cbc.ca/sports/1", "t", "city", "Politics"),
    ("fp_top", "Sports desk", "https://a.ca/1", "t", "", "Business"),
    ("k", "Arts and culture", "https://cbc.ca/news/health/2", "t", "", "Entertainment"),
    ("k", "n", "https://www.cbc.ca/news/science/2", "hockey", "", "Technology"),
    ("k", "n", "https://globalnews.ca/news/money/9", "hockey", "", "Business"),
    ("k", "n", "https://www.thestar.com/federal-politics/x", "hockey", "", "Politics"),
    ("k", "n", "https://torontosun.com/news/provincial/x", "hockey", "", "Canada"),
    ("k", "n", "https://ctvnews.ca/canada/x", "A stanley cup for all", "", "Sports"),
    ("k", "n", "https://a.ca/politics/x", "The hospital opens", "", "Health"),
    ("k", "n", "", "Nothing of note", " Province ", "Canada"),
    ("k", "n", "", "Nothing of note", "city", "Other"),
    ("k", "n", "https://cbc.ca/news/world/x", "hockey", "national", "Other"),
)
TOLD = ("Housing and rent rise", "AI startup is hiring", "A border visa", "Quiet day", "Election and jobs and housing", "Rental car", "parliament")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as feed bodies, the last item of each cut short, and read back as article rows."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null")
    item = F.concat(
        F.lit("<item><title>"), F.when(n % 4 > 0, F.concat(F.lit("Story "), n)).otherwise(""), F.lit("</title><link>"), F.when(n % 10 > 0, F.concat(F.lit("https://x.ca/"), n)).otherwise(" "),
        F.lit("</link><pubDate>"), F.when(n % 3 > 0, F.concat(F.lit("Fri, 20 Mar 2026 18:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(":00 GMT"))).otherwise("soon"), F.lit("</pubDate><description>"),
        _escaped(F.col("text")), F.lit('</description><enclosure url="https://i.ca/'), n, F.when(n % 2 == 0, '.jpg" type="image/jpeg" length="5"/></item>').otherwise('.mp3" type="audio/mpeg" length="5"/></item>'),
    )
    body = F.concat(F.lit("<?xml version='1.0'?><rss><channel><title>Feed</title>"), item, F.lit("<item><title>cut"))
    bodies = docs.select(F.lit("national_cbc_top").alias("registry_key"), "doc_id", body.alias("body"))
    items = rss.items_of(bodies).drop("entry_pos").withColumnRenamed("doc_id", "entry_pos")
    rows = rss.to_articles(items, dims.sources(spark), F.lit("2026-03-21 00:00:00").cast("timestamp"))
    return rows.select("link", "title", F.unix_timestamp("published_ts").alias("unix"), F.length("excerpt").alias("n_excerpt"), F.coalesce("image_url", F.lit("")).alias("image_url"), "source", "coverage_level")


def store_cycle(spark: SparkSession, d: str) -> DataFrame:
    """K1 to K3, K6, Q1, Q7, Q8, Q13, Q14, Q16, Q17: rows after each write of a store's life, a column added on the way."""
    store = Store(spark, scratch(spark, "store"))
    news = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("").alias("summary"), F.lit("pending").alias("summary_status"))
    count = lambda step, df: df.agg(F.lit(step).alias("step"), F.count("*").alias("n"))
    out = []
    store.append(news.where("id % 2 = 0"))
    out.append(store.read("news").count())
    store.append(news.where("id % 2 = 1").withColumn("topic", F.lit("new column")))
    out.append(store.read("news").where("topic is not null").count())
    store.replace_scope(news, "Ottawa", "Ontario")
    store.replace_scope(news.where("id % 5 = 0"), "Regina", "Saskatchewan")
    store.replace_scope(news.where("id % 3 = 0"), "Ottawa", "Ontario")
    store.update_summaries(news.where("id % 7 = 0").select("id", F.lit("first").alias("summary"), F.lit("failed").alias("summary_status"), F.lit(1).alias("updated_at")))
    store.update_summaries(news.where("id % 14 = 0").select("id", F.lit("last").alias("summary"), F.lit("ready").alias("summary_status"), F.lit(2).alias("updated_at")))
    told = store.with_summaries(store.read("news"))
    steps = [
        news.limit(1).select(F.lit("appended").alias("step"), F.lit(out[0]).cast("long").alias("n")),
        news.limit(1).select(F.lit("widened").alias("step"), F.lit(out[1]).cast("long").alias("n")),
        count("whole", store.read("news")),
        count("ottawa", store.read_scope("Ottawa", "Ontario")),
        count("regina", store.read_scope("Regina", "Saskatchewan")),
        count("ready", told.where("summary = 'last' and summary_status = 'ready'")),
        count("failed", told.where("summary = 'first' and summary_status = 'failed'")),
    ]
    whole = steps[0]
    for s in steps[1:]:
        whole = whole.unionByName(s)
    return whole


def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """Articles that arrive in several files, merged batch by batch; a link is stored once."""
    place = scratch(spark, "stream")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("pos"), F.concat(F.lit("https://e.ca/"), "user_id", F.lit("/"), "event_type").alias("link"), F.concat_ws(" ", "event_type", "user_id").alias("title"), F.lit("s").alias("source"), F.lit("").alias("published_text")
    )
    rows.repartition(3, "pos").write.parquet(f"{place}/inbox")
    store = Store(spark, f"{place}/store")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/inbox")
    start_merge(stream, store, f"{place}/checkpoint", None).awaitTermination()
    return store.read("news").groupBy("link_key").agg(F.count("*").alias("n"))


def region_words(spark: SparkSession, d: str) -> DataFrame:
    """G1: the real region rules, by the first and last word of each."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Item "), dealt(tuple(w for _, w in REGION_WORDS), F.col("doc_id")), F.lit(" end")).alias("title"))
    return docs.select("doc_id", classify.infer_region(F.col("title"), F.lit(None).cast("string")).alias("region"))


def topic_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The real topic rules, by feed key, feed name, link, words and level."""
    case = lambda k: dealt(tuple(c[k] for c in TOPIC_CASES), F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", classify.assign_topic(case(0), case(1), case(2), case(3), F.lit(""), case(4)).alias("topic"))


def for_you(spark: SparkSession, d: str) -> DataFrame:
    """Stories that match most followed topics, and topic ids in canonical order."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), dealt(TOLD, F.col("doc_id")).alias("title"), F.lit("").alias("summary"), F.lit("").alias("topic"), F.lit("").alias("category"))
    out = readers.for_you(rows, ["housing", "jobs", "ai"])
    return out.select("pos", F.array_join(readers.canonical_topics(F.col("matched")), ",").alias("matched"))


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """Articles joined to the first of their link."""
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("HTTPS://E.ca/"), F.col("event_id") % 900, F.lit("?u="), "user_id").alias("link"), F.lit("").alias("title"), F.lit("").alias("excerpt"))
    return cluster.link_edges(cluster.prepare(e))


def union_counts(spark: SparkSession, d: str) -> DataFrame:
    """By how much each stage of edges lowers the number of stories."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"))
    edge = lambda n: docs.select((F.col("pos") % n).alias("a"), F.col("pos").alias("b")).where("a < b")
    return ingest.union_counts(docs, {"link": edge(100), "wording": edge(10), "vectors": edge(50)})


def fill_some(spark: SparkSession, d: str) -> DataFrame:
    """A bounded fill of pending rows."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("A title").alias("title"), F.lit("").alias("excerpt"), F.when(F.col("doc_id") % 3 == 0, "ready").alias("summary_status"))
    return fill_pending(rows, 25)


def fetch_report(spark: SparkSession, d: str) -> DataFrame:
    """What a scan of feeds fetched, and the first errors."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("registry_key"), (F.col("n_nationkey") % 2 == 0).alias("ok"), F.concat(F.lit("e"), "n_nationkey").alias("error"))
    report = ingest.scan_report(n)
    return report.select("feeds_requested", "feeds_fetched", "feeds_failed", F.array_join(F.transform("failed_samples", lambda x: F.concat_ws(":", x["registry_key"], x["error"])), ",").alias("samples"))


def general_sources(spark: SparkSession, d: str) -> DataFrame:
    """The feeds of a general scan."""
    return feedplan.general_entries(dims.sources(spark)).select("registry_key", "feed_url")


def local_sources(spark: SparkSession, d: str) -> DataFrame:
    """The feeds of a local scan for a covered city that the registry lacks, from its slug."""
    return feedplan.feed_plan(dims.sources(spark), "St. Albert", "Alberta", True).entries.where("tier < 3").select("registry_key", "feed_url", "tier")


def pages_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Each page once, whatever the spelling of its links."""
    p = table(spark, d, "pages").select(F.concat(F.lit("HTTP://P.ca/"), F.col("page_id") % 90, F.when(F.col("page_id") % 2 == 0, "/?x=1").otherwise("")).alias("link"))
    return p.select(naming.page_key(F.col("link")).alias("page_key")).distinct()


def public_rows(spark: SparkSession, d: str) -> DataFrame:
    """Public columns alone, with the stored summary where it is ready, else one made."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        n.alias("id"), F.lit("A title").alias("title"), F.when(n % 2 == 0, "Stored  words").otherwise(" ").alias("summary"), dealt(("ready", "pending", "FAILED", None), n).alias("summary_status"),
        F.lit("Short text of one line.").alias("excerpt"), F.lit("l").alias("link"), "source", F.lit(1).alias("internal"),
    )
    return feed.public_view(rows)


def all_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Q15, P5: the whole feed in order, of the first term that is not blank."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rank_score"), F.col("o_orderpriority").alias("title"))
    return feed.search(o, "  ", " HIGH").orderBy(*feed.feed_order()).select("id", "title")


def dates_shown(spark: SparkSession, d: str) -> DataFrame:
    """Dates as readers see them."""
    ts = F.when(F.col("event_id") % 3 == 0, F.date_trunc("DAY", F.col("ts").cast("timestamp"))).otherwise(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", dates.display_published(ts).alias("shown"), dates.brief_title(ts).alias("heading"))


def helper_keys(spark: SparkSession, d: str) -> DataFrame:
    """Placeholder, absolute picture, aggregator, host tests, hue and slug."""
    n, hosts = F.col("page_id"), ("https://www.bbc.co.uk/a", "https://notbbc.com.ca/a", "https://news.google.com/a", "http://a.nationalpost.com:80/x", "https://xcnn.com/", "https://u@www.CNN.com")
    p = table(spark, d, "pages").select("page_id", dealt(hosts, n).alias("link"), dealt(("b.png", "/c/d.png", "//e.ca/f.png", "https://g.ca/h.png", ""), n).alias("picture"), F.col("url"))
    return p.select(
        "page_id", ingest.placeholder_url(ingest.placeholder_key(F.lit("Sports"), F.lit("CBC"), F.col("url"), F.col("link"))).alias("placeholder"),
        media.absolute_url(F.col("picture"), F.lit("https://x.ca/y/z.html?q=1")).alias("picture"), urls.is_aggregator(F.col("link")).alias("aggregator"),
        urls.is_blocked_host(F.col("link")).alias("blocked"), urls.is_home_host(F.col("link")).alias("home"), text.hash_hue(F.col("link")).alias("hue"),
    )


def bookmarks_cleared(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks as stored rows, after some readers clear them all."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.concat(F.lit("x/"), F.col("event_id") % 20).alias("link"), F.lit("save").alias("action"))
    return readers.saved_latest(readers.cleared(e, e.where("user_id % 3 = 0").select("user_id").distinct())).groupBy("user_id").agg(F.count("*").alias("n"))


def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entries of three feeds in the order in which the feeds are listed, the first of each text."""
    entries = lambda name, *turn: table(spark, d, name).where("text is not null").select(F.struct(*turn).alias("entry_pos"), "text")
    zero = F.lit(0).cast("long")
    feeds = [entries("benchmark", F.col("item_id").cast("long").alias("place"), zero.alias("part")), entries("documents", F.col("doc_id").cast("long").alias("place"), zero.alias("part")), entries("conversations", F.col("conv_id").cast("long").alias("place"), F.col("turn").cast("long").alias("part"))]
    first = dedupe.first_by(ingest.scanned(feeds), F.col("text"))
    return first.select("pos.feed", "pos.entry.place", "pos.entry.part", F.md5("text").alias("text_md5"))


def warm_stories(spark: SparkSession, d: str) -> DataFrame:
    """The three stories that are prepared ahead, here those with the longest texts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("rank_score"))
    return ingest.warm_up(docs)


QUERIES = {
    f.__name__: f
    for f in (
        feed_items, store_cycle, stream_merge, region_words, topic_assigned, for_you, link_edges, union_counts, fill_some, fetch_report, general_sources, local_sources, pages_to_fetch, public_rows, all_ordered,
        dates_shown, helper_keys, bookmarks_cleared, feed_scan, warm_stories,
    )
}

_SRC = dims.sql_values(dims.source_rows(), "registry_key, city, province, source_name, source_group, feed_url, coverage_level, priority, active, include_in_general")
_HOSTS = ("https://www.bbc.co.uk/a", "https://notbbc.com.ca/a", "https://news.google.com/a", "http://a.nationalpost.com:80/x", "https://xcnn.com/", "https://u@www.CNN.com")


def _hue(link: str) -> int:
    h = 0
    for c in link:
        h = (h * 31 + ord(c)) % 2**32
    return h % 360


ORACLES = {
    "feed_items": r"""WITH t AS (SELECT doc_id, least(12000, length(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 10 > 0)
        SELECT 'https://x.ca/' || doc_id AS link, CASE WHEN doc_id % 4 > 0 THEN 'Story ' || doc_id ELSE 'https://x.ca/' || doc_id END AS title,
          CASE WHEN doc_id % 3 > 0 THEN epoch(TIMESTAMP '2026-03-20 18:00:00')::BIGINT + 60 * (doc_id % 60) ELSE epoch(TIMESTAMP '2026-03-21')::BIGINT END AS unix, n::INTEGER AS n_excerpt,
          CASE WHEN doc_id % 2 = 0 THEN 'https://i.ca/' || doc_id || '.jpg' ELSE '' END AS image_url, 'CBC News' AS source, 'national' AS coverage_level FROM t""",
    "store_cycle": """SELECT unnest(['appended', 'widened', 'whole', 'ottawa', 'regina', 'ready', 'failed']) AS step, unnest([count(*) FILTER (doc_id % 2 = 0), count(*) FILTER (doc_id % 2 = 1), count(*), count(*) FILTER (doc_id % 3 = 0),
          count(*) FILTER (doc_id % 5 = 0), count(*) FILTER (doc_id % 14 = 0), count(*) FILTER (doc_id % 14 = 7)]) AS n FROM documents""",
    "stream_merge": "SELECT DISTINCT 'https://e.ca/' || user_id || '/' || lower(event_type) AS link_key, 1::BIGINT AS n FROM events",
    "region_words": f"SELECT doc_id, {dealt_sql(tuple(label for label, _ in REGION_WORDS), 'doc_id')} AS region FROM documents",
    "topic_assigned": f"SELECT doc_id, {dealt_sql(tuple(c[5] for c in TOPIC_CASES), 'doc_id')} AS topic FROM documents",
    "for_you": """WITH m AS (SELECT doc_id AS pos, ['housing', 'ai,jobs', '', '', 'jobs,housing', '', ''][1 + doc_id % 7] AS matched FROM documents)
        SELECT pos, matched FROM m WHERE matched <> '' ORDER BY len(string_split(matched, ',')) DESC, pos LIMIT 8""",
    "link_edges": "WITH f AS (SELECT event_id % 900 AS k, min(event_id) AS a FROM events GROUP BY 1) SELECT a, event_id AS b FROM events JOIN f ON event_id % 900 = k WHERE event_id > a",
    "union_counts": "SELECT unnest(['link', 'wording', 'vectors']) AS stage, unnest([count(*) - 100, 90, 0]) AS unions, count(*) AS articles FROM documents",
    "fill_some": "SELECT doc_id AS id, 'A title.' AS summary, 'ready' AS summary_status, 'title_fallback' AS summary_source FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 25",
    "fetch_report": """SELECT count(*) AS feeds_requested, count(*) FILTER (n_nationkey % 2 = 0) AS feeds_fetched, count(*) FILTER (n_nationkey % 2 = 1) AS feeds_failed,
          array_to_string((list(n_name || ':e' || n_nationkey ORDER BY n_name) FILTER (n_nationkey % 2 = 1))[:12], ',') AS samples FROM nation""",
    "feed_scan": """WITH e AS (SELECT 0 AS feed, item_id::BIGINT AS place, 0::BIGINT AS part, text FROM benchmark UNION ALL SELECT 1, doc_id, 0, text FROM documents UNION ALL SELECT 2, conv_id, turn, text FROM conversations)
        SELECT feed, place, part, md5(text) AS text_md5 FROM e WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY feed, place, part) = 1""",
    "warm_stories": "SELECT doc_id AS id, length(text)::DOUBLE AS rank_score FROM documents ORDER BY coalesce(length(text), 0) DESC, doc_id DESC LIMIT 3",
    "general_sources": f"SELECT registry_key, feed_url FROM {_SRC} WHERE active AND include_in_general",
    "local_sources": f"""SELECT registry_key, feed_url, 2 AS tier FROM {_SRC} WHERE active AND coverage_level = 'province' AND province = 'Alberta'
        UNION ALL SELECT 'st-albert_global_pattern', 'https://globalnews.ca/st-albert/feed/', 0 UNION ALL SELECT 'st-albert_cbc_pattern', 'https://www.cbc.ca/webfeed/rss/rss-canada-st-albert', 0
        UNION ALL SELECT 'st-albert_citynews_pattern', 'https://st-albert.citynews.ca/feed/', 0""",
    "pages_to_fetch": "SELECT DISTINCT 'http://p.ca/' || (page_id % 90) AS page_key FROM pages",
    "public_rows": """SELECT doc_id AS id, 'A title' AS title, CASE WHEN doc_id % 2 = 0 THEN 'Stored words.' ELSE 'Short text of one line.' END AS summary,
          ['ready', 'pending', 'FAILED', NULL][1 + doc_id % 4] AS summary_status, 'l' AS link, source FROM documents""",
    "all_ordered": "SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE contains(lower(o_orderpriority), 'high')",
    "dates_shown": """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts FROM events)
        SELECT event_id, CASE WHEN strftime(ts, '%H:%M:%S') <> '00:00:00' THEN strftime(ts, '%b %-d, %Y · %-I:%M %p') ELSE strftime(ts, '%b %-d, %Y') END AS shown, strftime(ts, '%A, %B %-d, %Y') AS heading FROM e""",
    "helper_keys": f"""WITH p AS (SELECT page_id, {dealt_sql(_HOSTS, 'page_id')} AS link, url FROM pages)
        SELECT page_id, {'[' + ', '.join(f"'{u}'" for u in dims.PLACEHOLDER_IMAGES) + ']'}[1 + (('0x' || substr(md5('sports|cbc|' || lower(url) || '|' || lower(link)), 1, 8))::BIGINT % 4)] AS placeholder,
          ['https://x.ca/y/b.png', 'https://x.ca/c/d.png', 'https://e.ca/f.png', 'https://g.ca/h.png', ''][1 + page_id % 5] AS picture, page_id % 6 = 2 AS aggregator, page_id % 6 IN (0, 5) AS blocked, page_id % 6 IN (1, 3) AS home,
          {[_hue(x) for x in _HOSTS]}[1 + page_id % 6]::INTEGER AS hue FROM p""",
    "bookmarks_cleared": "SELECT user_id, count(DISTINCT event_id % 20) AS n FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0 GROUP BY 1",
}
