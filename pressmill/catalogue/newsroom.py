"""Queries on ingest, names, pictures, places, pages as served and the reader's own view, with oracles written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media, naming, text, urls, wording
from ..operators import ingest, rank, readers, views
from ..plans import dims, feedplan
from .feeds import CITY, CITY_OF, PROVINCE, REGIONS
from .tables import PLACES_SQL, places, table

# Forms that the tables lack, dealt to their rows by number.
LABELS = (" CBC News - Toronto - Local", "", "Global News - Ottawa", "Reuters Canada", "The Star", "BBC - World", "My Google News feed", "Toronto Star", "Weekly Guardian", "National Post", "CTV Ottawa", "Town Crier")
LINKS = ("https://www.cbc.ca/news/canada/toronto/", "https://CBC.ca/news/entertainment/", "https://www.cbc.ca/sports/", "https://globalnews.ca/news/", "http://cbc.ca/news/canada/manitoba/x/canada/toronto/")
PICTURES = (
    "https://i.ca/a.jpg?w=320", "https://i.ca/a.jpg?w=1200", "https://i.ca/a-150x150.png", "https://i.ca/small/a.webp", " https://lh3.googleusercontent.com/p~(1)!*'x y", "https://i.ca/logo.svg",
    "", "https://www.youtube.com/watch?v=Ab_-1&t=3", "https://x.ca/watch?v=Ab1", "https://youtu.be/Z9?x=1", "https://www.YouTube.com/v/Qq", "https://player.vimeo.com/video/77", "https://vimeo.com/4455/x",
)
HTML = (
    '<meta property="og:image" content="/small.jpg?w=100"><meta content="https://p.ca/hero.jpg" property="og:image"><meta property="og:image" content="//p.ca/thumbnail.jpg?w=640">',
    '<meta name="twitter:image" content="https://p.ca/t.jpg"><img src="https://p.ca/i.jpg"><iframe width=1 src="https://www.youtube.com/embed/F1?a=b"></iframe>',
    '<link href="https://p.ca/l.jpg" rel="image_src"> see https://youtu.be/Y2 <iframe src="https://player.vimeo.com/video/9"></iframe>',
    '<img src="data:xx"><img width="20px" height=30 src="a.gif"><img data-src="pic/b.png" width="79" height="80"><video controls><source src="c.avi"><source src="https://v.ca/d.MP4"></video>',
    '<a href="/x">x</a><a href="https://www.google.com/z">g</a><a href="https://www.youtube.com/q">y</a><a href="https://out.ca/story">o</a> https://vimeo.com/31',
    '<link rel="canonical" href="https://news.google.com/a"><link rel=canonical href="https://own.ca/b?c=1&amp;d=2"><a href="https://out.ca/story">o</a>',
)


def dealt(values: tuple[str, ...], number):
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def dealt_sql(values: tuple[str, ...], number: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][1 + {number} % {len(values)}]"


def source_naming(spark: SparkSession, d: str) -> DataFrame:
    """Label, desk and group of each article."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        "doc_id", F.when(F.col("doc_id") % 13 == 0, F.col("source")).otherwise(dealt(LABELS, F.col("doc_id"))).alias("source"), F.concat(dealt(LINKS, F.col("doc_id")), "doc_id").alias("link")
    )
    return naming.named(rows).select("doc_id", "source", "source_group")


def page_keys(spark: SparkSession, d: str) -> DataFrame:
    """A page's cache key, picture and address tests, and its site's icon."""
    u = F.col("url")
    forms = F.when(F.col("page_id") % 4 == 0, F.concat(F.upper(F.regexp_replace(u, "[?#].*$", "")), F.lit("/"))).when(F.col("page_id") % 4 == 1, F.concat(u, F.lit(".JPG?x=1"))).when(F.col("page_id") % 4 == 2, F.lit(" ")).otherwise(u)
    p = table(spark, d, "pages").select("page_id", forms.alias("u"))
    return p.select("page_id", naming.page_key(F.col("u")).alias("page_key"), urls.looks_like_image(F.col("u")).alias("picture"), urls.is_http(F.col("u")).alias("http"), naming.site_icon(F.col("u"), "none").alias("icon"))


def hero_images(spark: SparkSession, d: str) -> DataFrame:
    """Pictures as shown large, small and decorative ones told apart, and pictures of videos."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.col("url")).otherwise(dealt(PICTURES, F.col("page_id"))).alias("u"))
    hero = media.hero_image(F.col("u"))
    return p.select("page_id", media.is_low_resolution(F.col("u")).alias("low"), media.is_decoration(F.col("u")).alias("decoration"), hero["src"].alias("src"), hero["via_proxy"].alias("via_proxy"), media.video_thumbnail(F.col("u")).alias("thumb"))


def page_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Picture, its kind, video and publisher link of whole pages, whose heads get the tags that the tables lack."""
    whole = F.concat(dealt(HTML, F.col("page_id")), "html")
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 6, F.col("html")).otherwise(whole).alias("h"))
    found = media.page_picture(F.col("h"), F.lit("https://p.ca/d/e.html"))
    return p.select("page_id", found["url"].alias("image"), found["kind"].alias("kind"), media.video_url(F.col("h")).alias("video"), media.publisher_link(F.col("h")).alias("leads_to"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as feed entries: links repeat, regions and pictures vary."""
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("pos"), F.concat(F.lit("Story "), n).alias("title"), F.concat(F.when(n % 5 == 0, "https://www.bbc.com/").otherwise("https://cbc.ca/"), n % 700, F.lit("/?utm_source=x")).alias("link"),
        F.concat(F.lit("CBC - "), "source").alias("source"), F.concat(F.lit("p"), n % 990).alias("published_text"), F.timestamp_add("MINUTE", -(n * 37 % 1000).cast("int"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).alias("published_ts"),
        F.col("text").alias("excerpt"), dealt(("", "Canada", "World", "Ontario", "Paris"), n).alias("region"), F.lit("").alias("topic"), F.col("lang").alias("category"),
        dealt(("city", "Civic", "province", " National", "", None), n).alias("coverage_level"), F.when(n % 9 > 0, F.col("lang")).alias("registry_key"),
        F.when(n % 3 == 0, F.concat(F.lit("https://i.ca/"), n % 40)).when(n % 3 == 1, F.lit("ftp://i.ca/x")).alias("image_url"),
        F.when(n % 4 == 0, F.struct(F.concat(F.lit("https://g.ca/"), n % 20).alias("url"), F.lit("og").alias("kind"))).alias("page_image"), (n % 8 == 0).alias("resolved"),
    )


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """What each step of an ingest takes and leaves."""
    return ingest.report(ingest.judged(naming.named(_entries(spark, d))))


def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """The newest 150 home stories with their pictures and where those are from."""
    rows = ingest.with_pictures(ingest.batch(ingest.judged(naming.named(_entries(spark, d)))))
    return rows.select("pos", "idx", "source", "image_url", "image_outcome")


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Stories of a batch for each picture outcome."""
    return ingest.outcome_counts(ingest.with_pictures(ingest.batch(ingest.judged(naming.named(_entries(spark, d))))))


def ingest_levels(spark: SparkSession, d: str) -> DataFrame:
    """Entries for each tier, feed and coverage level."""
    e = _entries(spark, d)
    rows = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("value"), "n")
    return rows(ingest.tier_counts(e), "tier", "tier").unionByName(rows(ingest.registry_counts(e), "feed", "registry_key")).unionByName(rows(ingest.level_counts(e), "level", "coverage_level"))


def _news(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("id"), (n * 7919 % 1009 / 8.0).alias("rank_score"), F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("https://n.ca/"), n % 900).alias("link"), "source",
        F.lit("Stored words").alias("summary"), F.lit("ready").alias("summary_status"), F.col("text").alias("excerpt"), F.lit("").alias("published_text"),
        F.timestamp_add("HOUR", -(n % 50).cast("int"), F.lit("2024-05-01 12:00:00").cast("timestamp_ntz")).alias("published_ts"), F.when(n % 2 == 0, F.lit(" ")).otherwise(F.lit("Sports")).alias("topic"), F.col("lang").alias("category"),
        F.concat(F.lit("https://I.ca/p"), n % 3, F.lit("/")).alias("image_url"), F.concat(F.lit("2024-05-0"), 1 + n % 9).alias("last_updated_at"),
    )


def feed_envelope(spark: SparkSession, d: str) -> DataFrame:
    """A page of the feed with the totals beside it."""
    return views.page_rows(_news(spark, d), None, 7, 5).select("id", "total", "n_pages")


def local_envelope(spark: SparkSession, d: str) -> DataFrame:
    """A page of a search in a local order."""
    p = places(spark, d).withColumn("tier", (F.col("id") % 4).cast("int")).withColumn("local_score", F.col("rank_score"))
    return views.page_rows(p, p, 3, 50, "build", largest=100).select("id", "total", "n_pages")


def brief_full(spark: SparkSession, d: str) -> DataFrame:
    """The brief with labels, pictures of their own, reading time and newest update."""
    b = views.brief(_news(spark, d), F.lit("2024-05-01 13:00:00").cast("timestamp_ntz"))
    return b.select("id", "place", "label", "summary", "image_shown", "read_seconds", "read_label", "source_timestamp")


def by_place(spark: SparkSession, d: str) -> DataFrame:
    """Stories with boost, reason and effective rank; the eight best in their order."""
    out = rank.by_place(places(spark, d), CITY, PROVINCE, city_province=CITY_OF, provinces=REGIONS)
    return out.limit(8).select("id", rank.scaled(F.col("effective"), 2).alias("effective_e2"), "reason")


def place_mix(spark: SparkSession, d: str) -> DataFrame:
    """Stories for each kind of place, for a reader with a province alone and for one without a place."""
    p = places(spark, d)
    mix = lambda who, c, v: p.select(F.lit(who).alias("who"), rank.location_bucket(rank.location_boost(F.col("region"), c, v, city_province=CITY_OF, provinces=REGIONS)["reason"]).alias("bucket"))
    return mix("province", None, PROVINCE).unionByName(mix("nowhere", "", None)).groupBy("who", "bucket").agg(F.count("*").alias("n"))


def story_places(spark: SparkSession, d: str) -> DataFrame:
    """The line that places a story for a reader."""
    place = lambda c, v: views.story_place(F.col("region"), c, v, city_province=CITY_OF, provinces=REGIONS)
    return places(spark, d).select("id", place(CITY, PROVINCE).alias("here"), place(None, None).alias("anywhere"))


def _city_rows(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_name").alias("city"), F.col("r_name").alias("province"), F.substring("r_name", 1, 2).alias("province_code"), F.concat(F.lit("s"), "n_nationkey").alias("slug"),
        (F.col("n_nationkey") % 2 == 0).alias("strong_local_coverage"), F.col("n_nationkey").alias("turn"),
    )


def known_places(spark: SparkSession, d: str) -> DataFrame:
    """Preferences filled from the city table, with mode and coverage flag."""
    c = table(spark, d, "customer")
    prefs = c.select(
        "c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit(" nation_"), "c_nationkey")).alias("city"), dealt(("AFRICA", "america ", "ASIA", "Europe", "MIDDLE EAST"), F.col("c_nationkey")).alias("province"),
        F.lit(None).cast("string").alias("province_code"), F.lit(None).cast("string").alias("slug"), F.when(F.col("c_custkey") % 3 == 0, "home").otherwise("").alias("label"),
    )
    cities = _city_rows(spark, d)
    strong = views.located(prefs, cities).select("c_custkey", "strong_local_coverage")
    return views.enriched(prefs, cities).select("c_custkey", "city", "province_code", "slug", "label", "mode").join(strong, "c_custkey")


def preference_keys(spark: SparkSession, d: str) -> DataFrame:
    """U21."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", naming.preference_key(F.lit("local"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "ON"), F.lit(None).cast("string"), F.lit("s"), F.lit("l")).alias("key"))


def feed_needles(spark: SparkSession, d: str) -> DataFrame:
    """The outlet names of each city, from the registry."""
    return views.city_needles(dims.sources(spark)).select("city", F.array_join("needles", "|").alias("needles"))


def needle_hits(spark: SparkSession, d: str) -> DataFrame:
    """Stories whose outlet a city's feeds name."""
    rows = table(spark, d, "documents").select(F.concat(dealt(LABELS, F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, " CBC Toronto").otherwise("")).alias("source"))
    return views.needle_hits(rows, views.needles_for(dims.sources(spark), "Toronto")[0])


def plan_keys(spark: SparkSession, d: str) -> DataFrame:
    """The registry keys of each tier for a suburb, and whether its city has a feed of its own."""
    plan = feedplan.feed_plan(dims.sources(spark), "Laval", "Quebec").entries
    own = views.has_city_tier(plan, "Laval").select(F.lit("own city").alias("tier"), F.col("has_city_tier").cast("string").alias("registry_keys"))
    return views.coverage_keys(plan).select("tier", F.array_join("registry_keys", ",").alias("registry_keys")).unionByName(own)


def registry_entry(spark: SparkSession, d: str) -> DataFrame:
    """Entries of given keys."""
    return dims.sources(spark).where(F.col("registry_key").isin("national_cbc_top", "toronto_cbc_city")).select("registry_key", "feed_url")


def outlets_of(spark: SparkSession, d: str) -> DataFrame:
    """Outlets of a story, how many, and whether more than one."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.array("p_brand", "p_type")).alias("sources"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).alias("source"))
    return views.outlet_counts(p).select("p_partkey", F.array_join("outlets", "|").alias("outlets"), "n_outlets", "multi_source")


def _page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("event_type = 'view'").select(
        F.col("event_id").alias("pos"), "user_id", F.concat(F.lit("HTTPS://r.ca/"), (F.col("event_id") % 60).cast("string"), F.lit("/")).alias("link"), F.lit("t").alias("title"), F.lit("").alias("summary"), F.lit("").alias("region"),
        F.concat(F.lit("Cat"), (F.col("event_id") % 60 % 5).cast("string")).alias("category"), F.lit(None).cast("string").alias("topic"), F.lit("S").alias("source"), F.lit(None).cast("array<string>").alias("sources"),
    )


def _weights(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'click'")
    return readers.affinity(e.select("user_id", F.concat(F.lit("cat"), (F.col("event_id") % 5).cast("string")).alias("category"), F.lit("open").alias("kind")))


def client_view(spark: SparkSession, d: str) -> DataFrame:
    """Each reader's page without repeats, filtered, by affinity."""
    return views.client_view(_page(spark, d), _weights(spark, d), term="CAT").select("user_id", "pos", "affinity", "place")


def story_queue(spark: SparkSession, d: str) -> DataFrame:
    """Where each reader stands among unseen stories."""
    e = table(spark, d, "events").where("event_type = 'click'").select("user_id", F.concat(F.lit("https://r.ca/"), (F.col("event_id") % 60).cast("string")).alias("link"))
    q = views.queue(_page(spark, d), e, "https://r.ca/30")
    return q.select("user_id", "reason", "at", F.array_join("history", ",").alias("history"))


def reader_signals(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of a reader, and whether any category has weight."""
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id")
    return views.reader_signals(e, _weights(spark, d))


def topics_toggled(spark: SparkSession, d: str) -> DataFrame:
    """Followed topics with one put in or taken out."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(views.toggled(F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name"))), ",").alias("topics"))


def summary_rules(spark: SparkSession, d: str) -> DataFrame:
    """Texts without vague endings, without calls to read on, and cut to three sentences and 55 words."""
    c = table(spark, d, "conversations").where("text is not null and text != ''")
    said = F.concat("text", dealt((" Read more: now.", " Officials say more details may follow.", " Stay tuned.", ""), F.col("turn")))
    return c.select("conv_id", "turn", wording.without_vague_end(said).alias("ended"), wording.without_calls(said).alias("uncalled"), wording.clean_summary(said).alias("clean"))


def brackets_decoded(spark: SparkSession, d: str) -> DataFrame:
    """H1: text of fragments whose marks and letters are written as references."""
    docs = table(spark, d, "documents").where("text is not null")
    made = F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;amp;")), F.lit("é"), F.lit("&eacute;")), F.lit("e"), F.lit("&#x65;")), F.lit("</p> it&#8217;s &bogus; &#150;"))
    return docs.select("doc_id", text.plain(made).alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        source_naming, page_keys, hero_images, page_pictures, ingest_report, ingest_batch, ingest_outcomes, ingest_levels, feed_envelope, local_envelope, brief_full, by_place, place_mix,
        story_places, known_places, preference_keys, feed_needles, needle_hits, plan_keys, registry_entry, outlets_of, client_view, story_queue, reader_signals, topics_toggled, summary_rules, brackets_decoded,
    )
}

_SRC = dims.sql_values(dims.source_rows(), "registry_key, city, province, source_name, source_group, feed_url, coverage_level, priority, active, include_in_general")
_HOME = "(" + ", ".join(f"'{r}'" for r in dims.HOME_REGIONS) + ")"
_LABEL = f"trim(CASE WHEN doc_id % 13 = 0 THEN source ELSE {dealt_sql(LABELS, 'doc_id')} END)"
_NAMED = f"""a AS (SELECT doc_id, {_LABEL} AS s, lower({dealt_sql(LINKS, 'doc_id')}) AS l FROM documents),
    b AS (SELECT doc_id, l, CASE WHEN s = '' THEN 'Unknown' WHEN contains(s, ' - ') THEN trim(trim(s[:strpos(s, ' - ') - 1]) || ' ' || trim(s[strpos(s, ' - ') + 3:])) ELSE s END AS label FROM a)"""
_PARTS = r"""u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN upper(regexp_replace(url, '[?#].*$', '')) || '/' WHEN 1 THEN url || '.JPG?x=1' WHEN 2 THEN ' ' ELSE url END AS u FROM pages),
    m AS (SELECT page_id, trim(u) AS u, regexp_extract(trim(u), '^([A-Za-z]+)://([^/?#]*)([^?#]*)', ['scheme', 'host', 'path']) AS m FROM u)"""
_ENTRIES = f"""e AS (SELECT doc_id AS pos, 'https://' || CASE WHEN doc_id % 5 = 0 THEN 'www.bbc.com/' ELSE 'cbc.ca/' END || (doc_id % 700) AS key, TIMESTAMP '2024-05-01' - to_minutes(doc_id * 37 % 1000) AS ts, 'CBC ' || source AS source, lang,
    ['', 'Canada', 'World', 'Ontario', 'Paris'][1 + doc_id % 5] AS region, 'https://' || CASE WHEN doc_id % 5 = 0 THEN 'www.bbc.com/' ELSE 'cbc.ca/' END || (doc_id % 700) || '/?utm_source=x' AS link FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) = 1 AS first, region IN {_HOME} OR region = '' AND key NOT LIKE '%bbc.com%' AS home FROM e)"""
_BATCH = f"""{_ENTRIES}, k AS (SELECT *, row_number() OVER (ORDER BY ts DESC, pos) - 1 AS idx FROM f WHERE first AND home QUALIFY idx < 150),
    ph AS (SELECT *, {'[' + ', '.join(f"'{u}'" for u in dims.PLACEHOLDER_IMAGES) + ']'}[1 + (('0x' || substr(md5(lower(lang || '|' || source || '|story ' || pos || '|' || link)), 1, 8))::BIGINT % 4)] AS spare FROM k),
    g AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'https://i.ca/' || (pos % 40) WHEN idx >= 15 THEN spare WHEN pos % 4 = 0 THEN 'https://g.ca/' || (pos % 20) ELSE spare END AS raw,
        CASE WHEN pos % 3 = 0 THEN 'feed' WHEN idx >= 15 THEN 'placeholder_deferred' WHEN pos % 4 = 0 THEN CASE WHEN pos % 8 = 0 THEN 'og_final_url' ELSE 'og' END ELSE 'placeholder' END AS tag FROM ph),
    h AS (SELECT *, tag NOT LIKE 'placeholder%' AND row_number() OVER (PARTITION BY raw ORDER BY idx) > 1 AS again FROM g),
    i AS (SELECT *, again OR (tag LIKE 'placeholder%' AND coalesce(sum((tag LIKE 'placeholder%' OR again)::INTEGER) OVER (PARTITION BY spare ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0) AS dup FROM h),
    o AS (SELECT pos, idx::INTEGER AS idx, source, CASE WHEN dup THEN spare ELSE raw END AS image_url, CASE WHEN dup THEN 'placeholder_duplicate_image' ELSE tag END AS image_outcome FROM i)"""
_PROV = f"CASE WHEN region IN {REGIONS!r} THEN region ELSE (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = p.region) END"
_HERE = f"""t AS (SELECT p.*, {_PROV} AS home FROM p)"""
_W = "w AS (SELECT user_id, 'cat' || (event_id % 5) AS category, least(200.0::DOUBLE, 2.0::DOUBLE * count(*)) AS weight FROM events WHERE event_type = 'click' GROUP BY 1, 2)"

ORACLES = {
    "source_naming": f"""WITH {_NAMED}, c AS (SELECT doc_id, CASE WHEN NOT contains(l, 'cbc.ca') THEN label WHEN contains(l, '/canada/saskatchewan/') THEN 'CBC Saskatchewan' WHEN contains(l, '/canada/manitoba/') THEN 'CBC Manitoba'
          WHEN contains(l, '/canada/toronto/') THEN 'CBC Toronto' WHEN contains(l, '/canada/montreal/') THEN 'CBC Montreal' WHEN contains(l, '/news/entertainment/') THEN 'CBC News' ELSE label END AS source FROM b)
        SELECT doc_id, source, CASE WHEN source = '' THEN 'Unknown' WHEN lower(source) LIKE 'cbc%' THEN 'CBC' WHEN lower(source) LIKE '%google news%' THEN 'Google News' WHEN lower(source) LIKE 'global news%' THEN 'Global News'
          WHEN lower(source) LIKE '%reuters%' THEN 'Reuters' WHEN lower(source) LIKE 'bbc%' THEN 'BBC' WHEN lower(source) LIKE '%guardian%' THEN 'The Guardian' WHEN lower(source) LIKE 'ctv%' THEN 'CTV News'
          WHEN lower(source) LIKE '%national post%' THEN 'National Post' WHEN lower(source) LIKE '%toronto star%' OR lower(source) LIKE 'the star%' THEN 'Toronto Star' WHEN lower(source) LIKE '%financial post%' THEN 'Financial Post' ELSE source END AS source_group FROM c""",
    "page_keys": rf"""WITH {_PARTS} SELECT page_id, CASE WHEN u = '' THEN '' WHEN m.host <> '' THEN lower(m.scheme) || '://' || lower(m.host) || CASE WHEN rtrim(m.path, '/') = '' THEN '/' ELSE lower(rtrim(m.path, '/')) END ELSE lower(u) END AS page_key,
          regexp_matches(split_part(lower(u), '?', 1), '\.(jpg|jpeg|png|gif|webp|svg|bmp)$') AS picture, u LIKE 'http://%' OR u LIKE 'https://%' AS http,
          CASE WHEN m.host <> '' THEN 'https://www.google.com/s2/favicons?domain=' || m.host || '&sz=256' ELSE 'none' END AS icon FROM m""",
    "hero_images": rf"""WITH u AS (SELECT page_id, trim(CASE WHEN page_id % 7 = 0 THEN url ELSE {dealt_sql(PICTURES, 'page_id')} END) AS u FROM pages), l AS (SELECT *, lower(u) AS x FROM u),
        f AS (SELECT *, regexp_matches(x, '[?&]w=\d{{1,3}}(&|$)') OR regexp_matches(x, '[?&]width=\d{{1,3}}(&|$)') OR regexp_matches(x, '[?&]h=\d{{1,3}}(&|$)') OR regexp_matches(x, 'thumb|thumbnail|/small/|-\d{{2,3}}x\d{{2,3}}\.') AS low,
          regexp_matches(x, 'gstatic\.com/images/branding') OR regexp_matches(x, '/favicon\.|apple-touch-icon|sprite|logo\.(svg|png|webp|jpg)') AS decoration,
          contains(x, 'googleusercontent.com') OR contains(x, 'ggpht.com') OR contains(x, 'news.google.com') AS elsewhere FROM l),
        v AS (SELECT *, CASE WHEN contains(x, 'youtube.com') OR contains(x, 'youtu.be') THEN coalesce(nullif(regexp_extract(u, '(youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([a-zA-Z0-9_-]+)', 2), ''), nullif(regexp_extract(u, '(?i)youtube\.com/v/([a-zA-Z0-9_-]+)', 1), '')) END AS yt,
          CASE WHEN contains(x, 'vimeo.com') THEN nullif(regexp_extract(u, 'vimeo\.com/(\d+)', 1), '') END AS vi FROM f)
        SELECT page_id, low, decoration, CASE WHEN u = '' OR decoration THEN '' WHEN elsewhere OR low THEN 'https://images.weserv.nl/?url=' || replace(replace(replace(replace(replace(replace(url_encode(u), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') || '&w=1200&q=90&fit=cover' ELSE u END AS src,
          u <> '' AND NOT decoration AND (elsewhere OR low) AS via_proxy, CASE WHEN yt IS NOT NULL THEN 'https://img.youtube.com/vi/' || yt || '/hqdefault.jpg' WHEN vi IS NOT NULL THEN 'https://i.vimeocdn.com/video/' || vi || '.jpg' END AS thumb FROM v""",
    "page_pictures": """SELECT page_id, CASE WHEN page_id % 7 = 6 THEN NULL ELSE ['https://p.ca/hero.jpg', 'https://p.ca/t.jpg', 'https://p.ca/l.jpg', 'https://p.ca/d/pic/b.png', NULL, NULL][1 + page_id % 6] END AS image,
          CASE WHEN page_id % 7 = 6 THEN NULL ELSE ['og', 'og', 'og', 'html', NULL, NULL][1 + page_id % 6] END AS kind,
          CASE WHEN page_id % 7 = 6 THEN NULL ELSE [NULL, 'https://www.youtube.com/embed/F1?a=b', 'https://www.youtube.com/watch?v=Y2', 'https://v.ca/d.MP4', 'https://vimeo.com/31', NULL][1 + page_id % 6] END AS video,
          CASE WHEN page_id % 7 = 6 THEN '' ELSE ['', '', '', '', 'https://out.ca/story', 'https://own.ca/b?c=1&d=2'][1 + page_id % 6] END AS leads_to FROM pages""",
    "ingest_report": f"""WITH {_ENTRIES} SELECT count(*) AS raw_entries, count(*) FILTER (NOT first) AS skipped_duplicate_link, 0::BIGINT AS skipped_duplicate_content, count(*) FILTER (first) AS after_dedupe,
          count(*) FILTER (first AND home) AS after_home_filter, count(*) FILTER (first AND NOT home) AS filtered_not_home, least(150, count(*) FILTER (first AND home)) AS candidates FROM f""",
    "ingest_batch": f"WITH {_BATCH} SELECT * FROM o",
    "ingest_outcomes": f"WITH {_BATCH} SELECT image_outcome, count(*) AS n FROM o GROUP BY 1",
    "ingest_levels": """WITH e AS (SELECT coalesce(['city', 'civic', 'province', 'national', '', ''][1 + doc_id % 6], '') AS level, CASE WHEN doc_id % 9 > 0 AND lang IS NOT NULL AND trim(lang) <> '' THEN trim(lang) ELSE 'unknown' END AS feed FROM documents)
        SELECT 'tier' AS kind, CASE WHEN level IN ('city', 'civic') THEN 'city' WHEN level = '' THEN 'unknown' ELSE level END AS value, count(*) AS n FROM e GROUP BY 2
        UNION ALL SELECT 'feed', feed, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'level', CASE WHEN level = '' THEN 'legacy' ELSE level END, count(*) FROM e GROUP BY 2""",
    "feed_envelope": "SELECT doc_id AS id, count(*) OVER () AS total, ceil(count(*) OVER () / 5.0)::INTEGER AS n_pages FROM documents ORDER BY doc_id * 7919 % 1009 DESC, doc_id DESC LIMIT 5 OFFSET 30",
    "local_envelope": """WITH p AS (SELECT c_custkey AS id, c_acctbal, c_custkey % 4 AS tier FROM customer WHERE contains(lower(c_mktsegment), 'build'))
        SELECT id, count(*) OVER () AS total, ceil(count(*) OVER () / 50.0)::INTEGER AS n_pages FROM p ORDER BY tier, c_acctbal DESC, id DESC LIMIT 50 OFFSET 100""",
    "brief_full": """WITH w AS (SELECT doc_id AS id, doc_id * 7919 % 1009 / 8.0::DOUBLE AS score, lang, split_part(text, chr(10), 1) AS title, source FROM documents ORDER BY score DESC, id DESC LIMIT 80),
        s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id % 900 ORDER BY score DESC, id DESC) = 1),
        b AS (SELECT *, score + CASE WHEN id % 50 <= 12 THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END AS brief FROM s), k AS (SELECT *, row_number() OVER (ORDER BY brief DESC, id DESC)::INTEGER AS place FROM b QUALIFY place <= 5)
        SELECT id, place, CASE WHEN id % 2 = 1 THEN 'Sports' ELSE trim(lang) END AS label, 'Stored words.' AS summary,
          CASE WHEN row_number() OVER (PARTITION BY id % 3 ORDER BY place) > 1 THEN 'placeholder-' || (('0x' || substr(md5(coalesce(title, '') || '|https://n.ca/' || (id % 900) || '|' || source), 1, 8))::BIGINT % 4) ELSE 'https://I.ca/p' || (id % 3) || '/' END AS image_shown,
          20 AS read_seconds, '~20 sec' AS read_label, '2024-05-0' || max(1 + id % 9) OVER () AS source_timestamp FROM k""",
    "by_place": f"""WITH {PLACES_SQL}, {_HERE}, r AS (SELECT id, rank_score, CASE WHEN trim(region) = '' THEN 'empty_region' WHEN lower(region) = '{CITY.lower()}' THEN 'city_exact' WHEN lower(region) = '{PROVINCE.lower()}' THEN 'province_exact'
          WHEN lower(home) = '{PROVINCE.lower()}' THEN 'province_via_city' WHEN region = 'Canada' THEN 'national' ELSE 'baseline' END AS reason FROM t),
        x AS (SELECT id, reason, rank_score + CASE reason WHEN 'city_exact' THEN 92.0::DOUBLE WHEN 'province_exact' THEN 50.0::DOUBLE WHEN 'province_via_city' THEN 50.0::DOUBLE WHEN 'national' THEN 24.0::DOUBLE ELSE 0.0::DOUBLE END AS e FROM r)
        SELECT id, floor(e * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS effective_e2, reason FROM x ORDER BY e DESC, id DESC LIMIT 8""",
    "place_mix": f"""WITH {PLACES_SQL}, {_HERE}, b AS (SELECT 'province' AS who, CASE WHEN trim(region) = '' THEN 'other' WHEN lower(region) = '{PROVINCE.lower()}' OR lower(home) = '{PROVINCE.lower()}' THEN 'province' WHEN region = 'Canada' THEN 'national' ELSE 'other' END AS bucket FROM t
          UNION ALL SELECT 'nowhere', 'no_preference' FROM t) SELECT who, bucket, count(*) AS n FROM b GROUP BY 1, 2""",
    "story_places": f"""WITH {PLACES_SQL}, {_HERE} SELECT id, CASE WHEN lower(region) = '{CITY.lower()}' THEN 'Local to {CITY}' WHEN home = '{PROVINCE}' THEN '{PROVINCE}' ELSE nullif(region, '') END AS here, nullif(region, '') AS anywhere FROM t""",
    "known_places": """WITH c AS (SELECT c_custkey, c_nationkey AS k, CASE WHEN c_custkey % 4 > 0 THEN ' nation_' || c_nationkey END AS city, trim(lower(['AFRICA', 'america ', 'ASIA', 'Europe', 'MIDDLE EAST'][1 + c_nationkey % 5])) AS province,
            CASE WHEN c_custkey % 3 = 0 THEN 'home' ELSE '' END AS label FROM customer),
        n AS (SELECT n_name, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), j AS (SELECT c.*, n.n_name, n.n_nationkey, n.r_name FROM c LEFT JOIN n ON lower(n.n_name) = trim(c.city) AND lower(n.r_name) = c.province)
        SELECT c_custkey, coalesce(n_name, city) AS city, substr(r_name, 1, 2) AS province_code, 's' || n_nationkey AS slug, CASE WHEN label = '' AND city IS NOT NULL THEN coalesce(n_name, city) ELSE label END AS label,
          CASE WHEN n_name IS NOT NULL THEN 'local' ELSE 'general' END AS mode, coalesce(n_nationkey % 2 = 0, FALSE) AS strong_local_coverage FROM j""",
    "preference_keys": "SELECT c_custkey, 'local|' || c_mktsegment || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'ON' ELSE '' END || '||s|l' AS key FROM customer",
    "feed_needles": f"SELECT lower(city) AS city, string_agg(DISTINCT source_name, '|' ORDER BY source_name) AS needles FROM {_SRC} WHERE active AND coverage_level = 'city' GROUP BY 1",
    "needle_hits": f"""WITH s AS (SELECT lower({dealt_sql(LABELS, 'doc_id')} || CASE WHEN doc_id % 2 = 0 THEN ' CBC Toronto' ELSE '' END) AS s FROM documents), n AS (SELECT lower(source_name) AS n FROM {_SRC} WHERE active AND city = 'Toronto')
        SELECT count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM n WHERE contains(s.s, n.n))) AS curated FROM s""",
    "plan_keys": f"""WITH t AS (SELECT *, CASE WHEN lower(city) = 'montreal' THEN 'metro' WHEN coverage_level = 'province' AND province = 'Quebec' THEN 'province' WHEN coverage_level = 'national' THEN 'national' END AS tier FROM {_SRC} WHERE active)
        SELECT tier, string_agg(registry_key, ',' ORDER BY priority, registry_key) AS registry_keys FROM t WHERE tier IS NOT NULL GROUP BY 1 UNION ALL SELECT 'own city', 'false'""",
    "registry_entry": f"SELECT registry_key, feed_url FROM {_SRC} WHERE registry_key IN ('national_cbc_top', 'toronto_cbc_city')",
    "outlets_of": """WITH o AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN [p_brand, p_type] WHEN p_size % 2 = 0 THEN [trim(p_name)] ELSE [] END AS o FROM part)
        SELECT p_partkey, array_to_string(o, '|') AS outlets, len(o)::INTEGER AS n_outlets, len(o) > 1 AS multi_source FROM o""",
    "client_view": f"""WITH {_W}, v AS (SELECT user_id, min(event_id) AS pos, event_id % 60 AS k FROM events WHERE event_type = 'view' GROUP BY 1, 3)
        SELECT v.user_id, pos, coalesce(weight, 0.0) AS affinity, row_number() OVER (PARTITION BY v.user_id ORDER BY coalesce(weight, 0.0) DESC, pos)::INTEGER AS place
        FROM v LEFT JOIN w ON w.user_id = v.user_id AND w.category = 'cat' || (k % 5)""",
    "story_queue": """WITH s AS (SELECT DISTINCT user_id, event_id % 60 AS k FROM events WHERE event_type = 'click'), v AS (SELECT user_id, event_id AS pos, event_id % 60 AS k FROM events WHERE event_type = 'view'),
        f AS (SELECT v.*, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS turn FROM v WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = v.user_id AND s.k = v.k)),
        c AS (SELECT user_id, min(turn) FILTER (k = 30) AS upto FROM f GROUP BY 1), h AS (SELECT f.user_id, c.upto, list(f.k ORDER BY f.turn) AS ks FROM f JOIN c USING (user_id) WHERE f.turn <= coalesce(c.upto, 1) GROUP BY ALL)
        SELECT u.user_id, CASE WHEN h.user_id IS NULL THEN 'no_unseen' WHEN upto IS NOT NULL THEN 'preserve_unseen_path' ELSE 'seed_first_unseen' END AS reason, coalesce(len(ks) - 1, 0)::INTEGER AS at,
          coalesce(array_to_string(list_transform(ks, lambda k: 'HTTPS://r.ca/' || k || '/'), ','), '') AS history FROM (SELECT DISTINCT user_id FROM v) u LEFT JOIN h USING (user_id)""",
    "reader_signals": f"""WITH {_W}, p AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), g AS (SELECT user_id, bool_or(weight > 0) AS s FROM w GROUP BY 1)
        SELECT user_id, coalesce(n, 0) AS n_saved, coalesce(s, FALSE) AS has_signal FROM p FULL JOIN g USING (user_id)""",
    "topics_toggled": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || ',' || p_type || ',' || p_name END AS topics FROM part",
    "summary_rules": r"""WITH c AS (SELECT conv_id, turn, text || [' Read more: now.', ' Officials say more details may follow.', ' Stay tuned.', ''][1 + turn % 4] AS x, turn % 4 AS k FROM conversations WHERE text IS NOT NULL AND text <> ''),
        s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(trim(x, E' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, E' \t\n\r')), lambda y: y <> '') AS p,
          trim(regexp_replace(trim(x, E' \t\n\r'), '(?i)\bread\s+more\b[\s.:]*', '', 'g'), E' \t\n\r') AS uncalled FROM c),
        q AS (SELECT *, list_filter(string_split(regexp_replace(trim(regexp_replace(uncalled, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '')[:3] AS q FROM s),
        n AS (SELECT *, list_transform(q, lambda y: len(string_split(y, ' '))) AS n FROM q),
        k AS (SELECT *, len(list_filter(range(1, len(n) + 1), lambda i: list_sum(n[1:i]) <= 55)) AS whole FROM n),
        u AS (SELECT *, coalesce(list_sum(n[1:whole]), 0) AS used FROM k),
        h AS (SELECT *, CASE WHEN whole < len(q) AND used < 55 THEN array_to_string(string_split(q[whole + 1], ' ')[1:(55 - used)::BIGINT], ' ') ELSE '' END AS head FROM u),
        w AS (SELECT *, CASE WHEN head = '' OR regexp_matches(head, '[.!?]$') THEN head WHEN regexp_extract(head, '(?s)^(.+[.!?])', 1) <> '' THEN regexp_extract(head, '(?s)^(.+[.!?])', 1) ELSE head || '.' END AS tail FROM h),
        j AS (SELECT *, trim(array_to_string(q[1:whole], ' ') || ' ' || tail) AS j FROM w),
        t AS (SELECT *, regexp_replace(regexp_replace(replace(j, '...', '…'), '[.]{2,}$', '…'), '[.!?]{2,}$', '.') AS t FROM j)
        SELECT conv_id, turn, array_to_string(p[:len(p) - CASE WHEN length(p[-1]) >= 12 AND (k = 1 AND regexp_matches(p[-1], '(?i)more details may follow\.$') OR k = 2 AND regexp_matches(p[-1], '(?i)\bstay tuned\.$')) THEN 1 ELSE 0 END], ' ') AS ended,
          uncalled, CASE WHEN t = '' OR regexp_matches(t, '[.!?…]$') THEN t ELSE t || '.' END AS clean FROM t""",
    "brackets_decoded": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '&amp;', '&'), '<[^>]*>', ' ', 'g') || ' it’s &bogus; –', '\s+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL""",
}
