"""Queries on links, text, duplicates, labels, clusters, pages and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, media, text, urls
from ..operators import classify, cluster, components, dedupe, readers
from ..sources.store import fill_pending
from .tables import table

#: Words of the invented test prose, in place of real topic and region words.
TEST_TOPICS = (("Politics", ("thentand", "the", "minister")), ("Sports", ("erin", "ot", "stanley cup")), ("Other words", ("tion",)))
TEST_REGIONS = (("First", ("thand ", "eing")), ("Second", ("éau", "ung")), ("World", ("ción",)))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("excerpt"), "source", "lang")


_DOCS_SQL = "d AS (SELECT doc_id AS pos, split_part(text, chr(10), 1) AS title, text AS excerpt, source, lang FROM documents)"
_KEY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[–—-]', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def link_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Each form of a link's key, and the key of a search for the page's title as its words stand there."""
    u = F.col("url")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    search = F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("?UTM_x=1&&q"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("="), F.replace(title, F.lit("#"), F.lit("+")))), F.lit("&%67clid=2&b~*=%C3%A9%zz"))
    return table(spark, d, "pages").select(
        "page_id", urls.normalize_link(u).alias("ingest_key"), urls.story_link(u).alias("story_key"), urls.image_key(u).alias("image_key"), urls.client_link(u).alias("client_key"), urls.normalize_link(search).alias("search_key")
    )


_FORM_SQL = "replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"
_KEPT_SQL = (
    "list_transform(list_filter(string_split(substr({q}, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(url_decode(replace(x, '+', ' ')), '(?i)^(utm_[^=]*|fbclid|gclid|mc_eid|igshid|_ga|mkt_tok)(=|$)')),"
    f" lambda x: {_FORM_SQL.format(x="split_part(x, '=', 1)")} || '=' || {_FORM_SQL.format(x="substr(x, length(split_part(x, '=', 1)) + 2)")})"
)
_PARTS_SQL = rf"""
p AS (SELECT page_id, trim(url) AS url, regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS m, regexp_replace(url, '[?#].*$', '') || '?UTM_x=1&&q'
        || CASE WHEN page_id % 5 = 0 THEN '' ELSE '=' || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '#', '+') END || '&%67clid=2&b~*=%C3%A9%zz' AS s FROM pages),
k AS (SELECT page_id, url, lower(m.scheme) AS scheme, lower(m.host) AS host, m.path AS path, substr(s, strpos(s, '?')) AS asked,
        {_KEPT_SQL.format(q="m.query")} AS kept FROM p),
n AS (SELECT *, lower(scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END) AS whole FROM k)"""


def link_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each link."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("link"), F.lit("").alias("title"), F.lit("").alias("source"), F.lit("").alias("published_text"))
    return dedupe.dedupe_stable(dedupe.with_keys(p)).select("pos", "link_key")


def title_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """U7, U9."""
    docs = _docs(spark, d)
    return docs.select("pos", text.normalize_title(F.col("title")).alias("title_key"), text.fingerprint(F.col("title"), F.col("source"), F.col("lang")).alias("fingerprint"))


def title_client(spark: SparkSession, d: str) -> DataFrame:
    """The reader's title key and the sports test."""
    docs = _docs(spark, d)
    return docs.select("pos", text.client_title(F.col("title")).alias("client_key"), cluster.is_sports(F.lower("excerpt")).alias("sports"))


def image_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Repeated pictures of a page become placeholders."""
    docs = _docs(spark, d).withColumn("image", F.concat(F.lit("http://i/"), (F.col("pos") % 37).cast("string"))).withColumn("page", F.floor(F.col("pos") / 50))
    out = dedupe.unique_images(docs, "image", urls.image_key(F.col("image")), F.concat_ws("|", "source", F.col("pos").cast("string")), ["page"])
    return out.select("pos", "image_shown")


def source_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each trimmed address, blanks dropped."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name")).alias("feed_url"))
    return dedupe.first_by(p.where(F.trim("feed_url") != ""), F.trim("feed_url")).select("pos", F.trim("feed_url").alias("feed_url"))


def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Links and contents of articles with few values of each."""
    docs = _docs(spark, d).select(
        "pos", F.concat(F.lit("http://x/"), (F.col("pos") * 7919 % 300).cast("string")).alias("link"), F.concat(F.lit("t"), (F.col("pos") * F.col("pos") % 397).cast("string")).alias("title"),
        "source", F.lit("").alias("published_text"),
    )
    return dedupe.dedupe_greedy(dedupe.with_keys(docs.withColumn("source", F.lit("s")))).select("pos", "kept")


def _events_as_articles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("http://e/"), "user_id", F.lit("/"), "event_type").alias("link"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("title"),
        F.lit("s").alias("source"), F.lit("").alias("published_text"), "ts",
    )


def merge_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """A batch against all that was stored before, rows for each reason."""
    hour = F.date_format("ts", "HH")
    rows = _events_as_articles(spark, d).withColumns({"link": F.concat_ws("/", "link", hour), "title": F.concat_ws(" ", "title", hour)})
    keyed = dedupe.with_keys(rows)
    split = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    merged = dedupe.merge_new(keyed.where(F.col("ts") >= split), keyed.where(F.col("ts") < split))
    return merged.groupBy("reason").agg(F.count("*").alias("n"))


def latest_summary(spark: SparkSession, d: str) -> DataFrame:
    """K5: the last update of each row."""
    e = table(spark, d, "events")
    return dedupe.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def region_infer(spark: SparkSession, d: str) -> DataFrame:
    """Regions by ordered substring rules; World goes."""
    docs = _docs(spark, d).withColumn("region", classify.infer_region(F.col("title"), F.col("excerpt"), TEST_REGIONS, default="Home"))
    return docs.where(classify.is_home_article(F.col("region"), F.lit(""), ("First", "Second", "Home"))).select("pos", "region")


def topic_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Topics by keywords in a fixed priority."""
    blob = F.lower(F.substring(F.concat_ws(" ", "title", "excerpt"), 1, 12000))
    return _docs(spark, d).select("pos", classify.keyword_topic(blob, TEST_TOPICS).alias("topic"))


def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Topics with the first four titles of each."""
    blob = F.lower(F.substring(F.concat_ws(" ", "title", "excerpt"), 1, 12000))
    t = _docs(spark, d).select("pos", "title", classify.keyword_topic(blob, TEST_TOPICS).alias("topic"))
    return classify.topic_samples(t, 4).select("topic", "n", F.array_join("titles", "|").alias("titles"))


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows for each source and language."""
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs")
    )


def followed_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics whose words stand alone in the text."""
    topics = {"a": ("red", "hot gear"), "b": ("ring", "blue  bolt"), "c": ("small",)}
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(classify.followed_topics(F.col("p_name"), F.lower("p_type"), topics=topics), ",").alias("topics"))


def _part_pairs(p: DataFrame) -> DataFrame:
    rows = p.select(F.col("p_partkey").alias("pos"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("s"), "p_size"))), " ")).alias("words"))
    return cluster.overlap_pairs(rows, 0.6)


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All parts by shared words of name, type, brand and size."""
    return _part_pairs(table(spark, d, "part"))


def containment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts and documents' first lines where one holds the other."""
    of = lambda name, pos, title: (F.struct(F.lit(name).alias("of"), F.col(pos).alias("id")).alias("pos"), text.story_title(F.col(title)).alias("story"))
    titles = _docs(spark, d).select(*of("documents", "pos", "title")).unionByName(table(spark, d, "benchmark").select(*of("benchmark", "item_id", "text")))
    pairs = cluster.contained_candidates(titles)
    return pairs.select(F.col("a.of").alias("x_of"), F.col("a.id").alias("x"), F.col("b.of").alias("y_of"), F.col("b.id").alias("y"))


def lexical_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Whole wording clusters of documents by first line, text and keyword topic; there are no links."""
    blob = F.lower(F.substring(F.concat_ws(" ", "title", "excerpt"), 1, 12000))
    docs = _docs(spark, d).withColumns({"link": F.lit(""), "topic": classify.keyword_topic(blob, TEST_TOPICS)})
    labels = components.components(cluster.wording_links(cluster.prepare(docs)))
    return labels.groupBy("component").agg(F.count("*").alias("n"))


def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All vectors and a copy of each without its first four numbers, paired at the clusters' cosine."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    less = F.transform("embedding", lambda x, i: F.when(i < 4, F.lit(0.0).cast("float")).otherwise(x))
    both = e.unionByName(e.select((-1 - F.col("pos")).alias("pos"), less.alias("embedding")))
    return cluster.near_vectors(both, cluster.ClusterConfig().cosine).select("a", "b")


def cosine_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of those pairs."""
    return components.components(cosine_pairs(spark, d))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each turn."""
    c = table(spark, d, "conversations").where("text is not null")
    s = text.sentences(F.col("text"))
    return c.select("conv_id", "turn", F.size(s).alias("n"), F.array_join(s, "|").alias("joined"))


def summary_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at 220 characters."""
    return _docs(spark, d).select("pos", text.clamp(F.col("excerpt")).alias("summary"))


def summary_display(spark: SparkSession, d: str) -> DataFrame:
    """The summary made from an excerpt, with its source."""
    return text.add_summary(_docs(spark, d), "title", "excerpt").select("pos", "made.summary", "made.summary_source")


def summary_fill(spark: SparkSession, d: str) -> DataFrame:
    """Updates for pending rows."""
    rows = _docs(spark, d).withColumnRenamed("pos", "id").withColumn("summary_status", F.when(F.col("id") % 3 == 0, "ready").when(F.col("id") % 3 == 1, " PENDING"))
    return fill_pending(rows).select("id", "summary_status", "summary_source")


def page_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """H7: text of a page's first paragraph."""
    return table(spark, d, "pages").select("page_id", text.plain(media.first_paragraph(F.col("html"))).alias("first_text"))


def page_description(spark: SparkSession, d: str) -> DataFrame:
    """H7: what a page says of itself: its title as one of three meta tags, short ones passed over, else its first paragraph."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    kind = F.get(F.array(*[F.lit(x) for x in ('property="og:description"', 'name="description"', "name='twitter:description'", 'name="other"')]), (F.col("page_id") % 4).cast("int"))
    html = F.concat(F.lit("<meta "), kind, F.lit(' content=" '), F.replace(title, F.lit('"'), F.lit("")), F.lit('">'), "html")
    return table(spark, d, "pages").select("page_id", media.page_description(html, text.plain(media.first_paragraph(F.col("html")))).alias("said"))


def page_media(spark: SparkSession, d: str) -> DataFrame:
    """H2, H10, H11 and H4, H5 in part: pictures and videos of fragments built around the pages' links; see Open in the README."""
    u = F.regexp_replace("url", "[?#].*$", "")
    html = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<meta property="og:image" content="'), u, F.lit('"><iframe src="https://www.youtube.com/embed/Ab_1"></iframe>')))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit('<meta content="'), u, F.lit('" name="twitter:image"> https://vimeo.com/123')))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<img class="x" src="data:abc"><img alt="" src="'), u, F.lit('"> youtu.be/Z9')))
        .otherwise(F.lit("<p>no media</p>"))
    )
    p = table(spark, d, "pages").select("page_id", html.alias("h"))
    return p.select("page_id", media.page_image(F.col("h")).alias("image"), media.video_url(F.col("h")).alias("video"), media.video_thumbnail(media.video_url(F.col("h"))).alias("thumb"))


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Published forms written from event times and read back."""
    ts = F.date_trunc("MINUTE", F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", ts.alias("ts"))
    form = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 5 == 2, F.date_format("ts", "MMM d, yyyy HH:mm"))
        .when(F.col("event_id") % 5 == 3, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .otherwise(F.lit("yesterday"))
    )
    return e.select("event_id", F.coalesce(F.unix_timestamp(dates.parse_published(form)), F.lit(-1)).alias("unix"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "purchase", "save").when(F.col("event_type") == "click", "search")
    return e.select("event_id", "user_id", F.concat(F.lit("Cat"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("category"), kind.alias("kind"), "ts")


def affinity_weights(spark: SparkSession, d: str) -> DataFrame:
    """A24, X9."""
    return readers.affinity(_signals(spark, d))


def affinity_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Each reader's views in order of category weight."""
    signals = _signals(spark, d)
    articles = signals.where("kind = 'open'").select(F.col("event_id").alias("pos"), "user_id", "category")
    return readers.rerank(articles, readers.affinity(signals)).select("pos", "user_id", "affinity", "place")


def search_interest(spark: SparkSession, d: str) -> DataFrame:
    """Searches that name a category."""
    e = table(spark, d, "events").where("event_type = 'click'")
    s = e.select("user_id", F.col("event_id").alias("search_id"), F.concat(F.lit("go cat"), (F.col("event_id") % 7).cast("string"), F.lit(" "), "event_type").alias("query"))
    cats = _signals(spark, d).select("category").distinct()
    return readers.search_interest(s, cats)


def seen_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Views whose link the reader hasn't clicked."""
    e = table(spark, d, "events").withColumn("link", F.concat(F.lit("HTTP://x/"), (F.col("event_id") % 40).cast("string"), F.lit("/")))
    return readers.unseen(e.where("event_type = 'view'"), e.where("event_type = 'click'").withColumn("link", F.lower("link"))).select("event_id")


def saved_latest(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks after saves and removals."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    rows = e.select("event_id", "user_id", "ts", F.concat(F.lit("x/"), (F.col("event_id") % 20).cast("string")).alias("link"), F.when(F.col("event_type") == "purchase", "save").otherwise("remove").alias("action"))
    return readers.saved_latest(rows).select("event_id", "user_id", "link")


def state_json(spark: SparkSession, d: str) -> DataFrame:
    """State read from JSON text."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        link_normalise, link_dedupe_first, title_fingerprint, title_client, image_dedupe, source_dedupe, greedy_dedupe, merge_new_rows, latest_summary,
        region_infer, topic_keyword, topic_counts, ingest_counts, followed_topics, jaccard_pairs, containment_pairs, lexical_clusters, cosine_pairs,
        cosine_components, sentence_split, summary_clamp, summary_display, summary_fill, page_paragraph, page_description, page_media, date_parse, affinity_weights,
        affinity_rerank, search_interest, seen_unseen, saved_latest, state_json,
    )
}

_BLOB = "lower(substr(title || ' ' || excerpt, 1, 12000))"
_EDGE = r"(?:^|$|[^\p{L}\p{M}\p{N}_])"
_TOPIC = rf"""CASE WHEN regexp_matches({_BLOB}, 'thentand|{_EDGE}the{_EDGE}|minister') THEN 'Politics' WHEN regexp_matches({_BLOB}, '{_EDGE}erin{_EDGE}|{_EDGE}(?:ot|o\.t\.){_EDGE}|stanley cup') THEN 'Sports'
    WHEN regexp_matches({_BLOB}, '{_EDGE}tion{_EDGE}') THEN 'Other words' ELSE 'Other' END"""
_SIGNALS = """g AS (SELECT event_id, user_id, 'cat' || ((props->>'$.k')::INTEGER % 5) AS category, CASE event_type WHEN 'view' THEN 2.0::DOUBLE WHEN 'purchase' THEN 8.0::DOUBLE WHEN 'click' THEN 1.5::DOUBLE END AS delta, event_type FROM events),
    w AS (SELECT user_id, category, least(200.0::DOUBLE, sum(delta)) AS weight FROM g WHERE delta IS NOT NULL GROUP BY 1, 2)"""
_COS = """u AS (SELECT vec_id AS pos, embedding::DOUBLE[64] AS v FROM embeddings UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 4 THEN 0.0::DOUBLE ELSE x::DOUBLE END)::DOUBLE[64] FROM embeddings),
    c AS (SELECT a.pos AS a, b.pos AS b FROM u a JOIN u b ON a.pos < b.pos WHERE array_cosine_similarity(a.v, b.v) >= 0.88)"""

_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_STORY = r"""CASE WHEN {0} = '' THEN 'untitled' ELSE {0} END""".format(
    _SQUEEZED.format(r"regexp_replace(regexp_replace(lower(trim(coalesce(t, ''))), '^(?:(?:breaking|just in|watch live|live updates?|live:|watch:|exclusive|update:?)\s*[:|\-–]?\s*)+', ''), '[^\p{L}\p{M}\p{N}_\s]+', ' ', 'g')")
)


def _tidy_sql(s: str) -> str:
    """The closing mark of a summary, as SQL."""
    one = rf"regexp_replace(regexp_replace(replace(trim({s}), '...', '…'), '[.]{{2,}}$', '…'), '[.!?]{{2,}}$', '.')"
    return f"CASE WHEN {one} = '' THEN '' WHEN regexp_matches({one}, '[.!?…]$') THEN {one} ELSE {one} || '.' END"


def _clamp_sql(s: str) -> str:
    """A squeezed text cut at 220 characters, as SQL."""
    before = f"regexp_extract(substr({s}, 1, 220), '^(.*) [^ ]*$', 1)"
    cut = f"CASE WHEN length({before}) > 110 THEN {before} ELSE substr({s}, 1, 220) END"
    whole, short = _tidy_sql(s), _tidy_sql(f"regexp_replace({cut}, '[.,; ]+$', '') || '…'")
    return f"CASE WHEN length({s}) <= 220 THEN {whole} ELSE {short} END"


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"

_PARAGRAPH_SQL = rf"""p AS (SELECT page_id, regexp_extract(html, '(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p[\s>]|$)', 1) AS x FROM pages),
        q AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM p),
        first AS (SELECT page_id, {_SQUEEZED.format("replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&mdash;', '—'), '&eacute;', 'é'), '&hellip;', '…'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&#39;', chr(39))")} AS first_text FROM q)"""

ORACLES = {
    "greedy_dedupe": """WITH RECURSIVE a AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS pos, doc_id * 7919 % 300 AS link, doc_id * doc_id % 397 AS content FROM documents),
        r AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS pos, []::BIGINT[] AS links, []::BIGINT[] AS contents, FALSE AS kept
          UNION ALL SELECT a.n, a.pos, CASE WHEN list_contains(links, link) OR list_contains(contents, content) THEN links ELSE list_append(links, link) END,
            CASE WHEN list_contains(links, link) OR list_contains(contents, content) THEN contents ELSE list_append(contents, content) END, NOT (list_contains(links, link) OR list_contains(contents, content)) FROM r JOIN a ON a.n = r.n + 1)
        SELECT pos, kept FROM r WHERE n > 0""",
    "containment_pairs": f"""WITH t AS (SELECT 'documents' AS of, doc_id AS id, split_part(text, chr(10), 1) AS t FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark), s AS (SELECT of, id, {_STORY} AS s FROM t)
        SELECT a.of AS x_of, a.id AS x, b.of AS y_of, b.id AS y FROM s a JOIN s b ON (a.of, a.id) < (b.of, b.id)
        WHERE least(length(a.s), length(b.s)) >= 18 AND least(length(a.s), length(b.s)) / greatest(length(a.s), length(b.s)) >= 0.48::DOUBLE AND (contains(a.s, b.s) OR contains(b.s, a.s))""",
    "summary_clamp": f"WITH t AS (SELECT doc_id AS pos, {_SQUEEZED.format('text')} AS s FROM documents) SELECT pos, {_clamp_sql('s')} AS summary FROM t",
    "summary_display": f"""WITH t AS (SELECT doc_id AS pos, trim(split_part(text, chr(10), 1)) AS title, trim(text) AS ex, {_SQUEEZED.format("regexp_replace(trim(text), '<[^>]*>', ' ', 'g')")} AS body FROM documents),
        p AS (SELECT *, array_to_string({_SENTENCES.format('body')}[:2], ' ') AS two FROM t), c AS (SELECT *, {_clamp_sql('two')} AS lead, {_clamp_sql('body')} AS whole FROM p)
        SELECT pos, CASE WHEN length(body) >= 40 AND length(lead) < 180 AND length(body) > length(lead) THEN whole WHEN length(body) >= 40 THEN lead WHEN length(body) >= 15 THEN whole ELSE {_clamp_sql("CASE WHEN title = '' THEN 'News update.' ELSE " + _SQUEEZED.format('title') + " END")} END AS summary,
          CASE WHEN length(body) < 15 THEN 'title_fallback' WHEN contains(ex, '<') AND contains(ex, '>') THEN 'html' ELSE 'rss' END AS summary_source FROM c""",
    "page_paragraph": rf"""WITH {_PARAGRAPH_SQL} SELECT page_id, first_text FROM first""",
    "page_description": rf"""WITH {_PARAGRAPH_SQL}, t AS (SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), chr(34), ''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages)
        SELECT page_id, CASE WHEN page_id % 4 < 3 AND length(title) >= 60 THEN substr(title, 1, 1800) WHEN length(first_text) >= 60 THEN substr(first_text, 1, 1800) ELSE '' END AS said FROM first JOIN t USING (page_id)""",
    "link_normalise": f"""WITH {_PARTS_SQL} SELECT page_id, CASE WHEN regexp_matches(whole, '^/+$') THEN '/' ELSE rtrim(whole, '/') END AS ingest_key,
        scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE lower(path) END AS story_key, CASE WHEN host <> '' AND rtrim(lower(path), '/') <> '' THEN host || rtrim(lower(path), '/') ELSE lower(url) END AS image_key, rtrim(lower(url), '/') AS client_key,
        rtrim(lower(scheme || '://' || host || path || '?' || array_to_string({_KEPT_SQL.format(q="asked")}, '&')), '/') AS search_key FROM n""",
    "link_dedupe_first": f"""WITH {_PARTS_SQL} SELECT min(page_id) AS pos, rtrim(whole, '/') AS link_key FROM n GROUP BY 2""",
    "title_fingerprint": f"""WITH {_DOCS_SQL}, t AS (SELECT *, {_KEY_SQL} AS title_key FROM d)
        SELECT pos, title_key, substr(sha256(title_key || '|' || lower(trim(source)) || '|' || lower(trim(lang))), 1, 32) AS fingerprint FROM t""",
    "title_client": rf"""WITH {_DOCS_SQL} SELECT pos, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[–—-]', ' ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS client_key,
        regexp_matches(lower(excerpt), ' vs\.? | @ |\d+\s*-\s*\d+') AS sports FROM d""",
    "image_dedupe": f"""WITH {_DOCS_SQL}, i AS (SELECT pos, source, 'http://i/' || (pos % 37) AS image, pos // 50 AS page FROM d)
        SELECT pos, CASE WHEN row_number() OVER (PARTITION BY page, image ORDER BY pos) > 1
          THEN 'placeholder-' || (('0x' || substr(md5(source || '|' || pos), 1, 8))::BIGINT % 4) ELSE image END AS image_shown FROM i""",
    "source_dedupe": "SELECT min(p_partkey) AS pos, trim(p_name) AS feed_url FROM part WHERE p_size % 7 <> 0 GROUP BY 2",
    "merge_new_rows": """WITH e AS (SELECT event_id, ts, user_id || '/' || event_type || '/' || hour(ts) AS k FROM events), s AS (SELECT DISTINCT k FROM e WHERE ts < TIMESTAMP '2024-01-20'),
        b AS (SELECT k, event_id FROM e WHERE ts >= TIMESTAMP '2024-01-20'), j AS (SELECT CASE WHEN k IN (SELECT k FROM s) THEN 'stored_link'
          WHEN row_number() OVER (PARTITION BY k ORDER BY event_id) = 1 THEN 'new' ELSE 'batch_duplicate' END AS reason FROM b) SELECT reason, count(*) AS n FROM j GROUP BY 1""",
    "latest_summary": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "region_infer": f"""WITH {_DOCS_SQL}, t AS (SELECT pos, lower(substr(title || ' ' || excerpt, 1, 2000)) AS x FROM d),
        r AS (SELECT pos, CASE WHEN contains(x, 'thand ') OR contains(x, 'eing') THEN 'First' WHEN contains(x, 'éau') OR contains(x, 'ung') THEN 'Second' WHEN contains(x, 'ción') THEN 'World' ELSE 'Home' END AS region FROM t)
        SELECT pos, region FROM r WHERE region <> 'World'""",
    "topic_keyword": f"WITH {_DOCS_SQL} SELECT pos, {_TOPIC} AS topic FROM d",
    "topic_counts": f"WITH {_DOCS_SQL} SELECT {_TOPIC} AS topic, count(*) AS n, array_to_string(list(title ORDER BY pos)[:4], '|') AS titles FROM d GROUP BY 1",
    "ingest_counts": "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1",
    "followed_topics": r"""WITH t AS (SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS x FROM part)
        SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9])(?:red|hot\s+gear)(?:[^a-z0-9]|$)') THEN 'a' END,
          CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9])(?:ring|blue\s+bolt)(?:[^a-z0-9]|$)') THEN 'b' END, CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9])(?:small)(?:[^a-z0-9]|$)') THEN 'c' END], lambda y: y IS NOT NULL), ',') AS topics FROM t""",
    "jaccard_pairs": """WITH w AS (SELECT p_partkey AS pos, list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type || ' s' || p_size), ' ')) AS w FROM part)
        SELECT a.pos AS a, b.pos AS b FROM w a JOIN w b ON a.pos < b.pos WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6""",
    "cosine_pairs": f"WITH {_COS} SELECT a, b FROM c",
    "cosine_components": f"""WITH RECURSIVE {_COS}, e AS (SELECT a, b FROM c UNION SELECT b, a FROM c), r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a)
        SELECT node, min(other) AS component FROM r GROUP BY 1""",
    "sentence_split": r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(trim(text, E' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS s FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, len(s)::INTEGER AS n, array_to_string(s, '|') AS joined FROM t""",
    "summary_fill": f"""WITH {_DOCS_SQL} SELECT pos AS id, 'ready' AS summary_status,
        CASE WHEN length(trim(regexp_replace(excerpt, '\\s+', ' ', 'g'))) >= 15 THEN CASE WHEN contains(excerpt, '<') AND contains(excerpt, '>') THEN 'html' ELSE 'rss' END ELSE 'title_fallback' END AS summary_source
        FROM d WHERE pos % 3 <> 0""",
    "page_media": """WITH t AS (SELECT page_id, page_id % 4 AS k, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
        SELECT page_id, CASE WHEN k < 3 THEN u END AS image, CASE k WHEN 0 THEN 'https://www.youtube.com/embed/Ab_1' WHEN 1 THEN 'https://vimeo.com/123' WHEN 2 THEN 'https://www.youtube.com/watch?v=Z9' END AS video,
          CASE k WHEN 0 THEN 'https://img.youtube.com/vi/Ab_1/hqdefault.jpg' WHEN 1 THEN 'https://i.vimeocdn.com/video/123.jpg' WHEN 2 THEN 'https://img.youtube.com/vi/Z9/hqdefault.jpg' END AS thumb FROM t""",
    "date_parse": "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN epoch(date_trunc('minute', ts))::BIGINT ELSE -1 END AS unix FROM events",
    "affinity_weights": f"WITH {_SIGNALS} SELECT * FROM w",
    "affinity_rerank": f"""WITH {_SIGNALS} SELECT g.event_id AS pos, g.user_id, coalesce(w.weight, 0.0) AS affinity,
        row_number() OVER (PARTITION BY g.user_id ORDER BY coalesce(w.weight, 0.0) DESC, g.event_id)::INTEGER AS place FROM g LEFT JOIN w USING (user_id, category) WHERE g.event_type = 'view'""",
    "search_interest": """WITH q AS (SELECT user_id, event_id AS search_id, unnest(['cat' || (event_id % 7), event_type]) AS word FROM events WHERE event_type = 'click'),
        k AS (SELECT DISTINCT 'cat' || ((props->>'$.k')::INTEGER % 5) AS category FROM events)
        SELECT DISTINCT user_id, search_id, category FROM q JOIN k ON contains(category, word) OR contains(word, category)""",
    "seen_unseen": """WITH s AS (SELECT DISTINCT user_id, event_id % 40 AS k FROM events WHERE event_type = 'click')
        SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.k = e.event_id % 40)""",
    "saved_latest": """WITH l AS (SELECT * FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts DESC, event_id DESC) = 1)
        SELECT event_id, user_id, 'x/' || (event_id % 20) AS link FROM l WHERE event_type = 'purchase'""",
    "state_json": "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events",
}
