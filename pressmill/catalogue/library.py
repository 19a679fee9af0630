"""Queries on the versioned store: refresh, merge by key, snapshots, and streams that go on after a restart."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, feed, ingest
from ..sources.fetch import SCHEMA, FeedSource
from ..sources.keys import KeyLayout, keys_of
from ..sources.store import Store, scratch
from ..streaming.merge import affinity_state, start_affinity
from .articles import _SIGNALS, _signals
from .newsroom import _ENTRIES, _entries, _news
from .tables import table

PLACE = ("Ottawa", "Ontario")
#: Requests of the cycle: when, for the place or the general feed, forced or not.
REQUESTS = (
    ("2024-01-20 00:00:00", False, False), ("2024-01-20 00:01:00", False, False), ("2024-01-20 00:02:00", True, False), ("2024-01-20 00:03:00", True, False),
    ("2024-01-25 00:00:00", True, False), ("2024-01-25 00:01:00", False, False), ("2024-01-25 00:02:00", False, True), ("2024-01-25 00:02:00", True, True),
)
#: Fetches of the merge, each with the last hour of the one before.
FETCHES = (("2024-01-01", "2024-01-11"), ("2024-01-10 23:00:00", "2024-01-21"), ("2024-01-20 23:00:00", "2024-02-01"))
BUCKETS = 64
FEEDS = 16


def refresh_cycle(spark: SparkSession, d: str) -> DataFrame:
    """What each request does with the store, the rows of news and place after it, and those a reader of the first version has."""
    store = Store(spark, scratch(spark, "refresh"))
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), "source", F.lit(None).cast("string").alias("link"), F.col("lang").alias("published_text")
    )
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("last_updated_at"))

    def make(at: str):
        def of(place: tuple[str, str] | None) -> DataFrame:
            if place:
                return events.where(F.col("last_updated_at") < F.lit(at).cast("timestamp_ntz"))
            fetched = docs if at >= "2024-01-25" else docs.where("published_text = 'en'")
            return dedupe.dedupe_stable(dedupe.with_keys(fetched))

        return of

    rows = lambda name, at: store.read(name, at).agg(F.count("*")) if store.has(name, at) else spark.range(1).select(F.lit(0).cast("long"))
    out = None
    for step, (at, local, forced) in enumerate(REQUESTS, 1):
        mode = ingest.refresh(store, make(at), F.lit(at).cast("timestamp_ntz"), PLACE if local else None, forced)
        now = store.version()
        counts = [rows("news", now).toDF("n_news"), rows(store.scope(*PLACE), now).toDF("n_local"), rows("news", 1).toDF("n_first")]
        row = counts[0].crossJoin(counts[1]).crossJoin(counts[2]).select(F.lit(step).alias("step"), F.lit(mode).alias("mode"), F.lit(now).cast("long").alias("version"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def merge_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping fetches merged by key; buckets that each asks and opens, and its rows by reason."""
    store = Store(spark, scratch(spark, "buckets"), KeyLayout(BUCKETS, 1))
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, d, "events").select(
        F.col("event_id").alias("pos"), F.concat_ws("/", F.lit("https://e.ca"), "user_id", "event_type", day).alias("link"), F.concat_ws(" ", "event_type", "user_id").alias("title"), F.lit("s").alias("source"), day.alias("published_text"), "ts"
    )
    out = None
    for turn, (start, end) in enumerate(FETCHES, 1):
        batch = store.staged(dedupe.with_keys(e.where((F.col("ts") >= start) & (F.col("ts") < end)).drop("ts")), "news")
        found = store.look_up(keys_of(batch))
        reasons = store.merge(batch, found=found).groupBy().pivot("reason", ["new", "stored_link", "batch_duplicate"]).agg(F.coalesce(F.sum("n"), F.lit(0)))
        row = reasons.select(
            F.lit(turn).alias("turn"), F.lit(found.buckets_asked).alias("buckets_asked"), F.lit(found.buckets_opened).alias("buckets_opened"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("new", "stored_link", "batch_duplicate")]
        )
        out = row if out is None else out.unionByName(row)
    return out


def brief_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The brief as a snapshot: made, read again, made anew when too old, and when the news have changed."""
    store, made = Store(spark, scratch(spark, "brief")), []

    def brief(news: DataFrame) -> DataFrame:
        made.append(news)
        best = feed.daily_brief(news, F.lit("2024-05-01 13:00:00").cast("timestamp_ntz"))
        return best.select("id", F.bround("brief_score", 3).alias("brief_score"))

    store.replace(_news(spark, d))
    out = None
    for read, (at, news) in enumerate(((datetime(2024, 5, 1, 13, 0), None), (datetime(2024, 5, 1, 13, 1), None), (datetime(2024, 5, 1, 13, 3), None), (datetime(2024, 5, 1, 13, 4), "category = 'en'")), 1):
        if news:
            store.replace(_news(spark, d).where(news))
        rows = store.snapshot("brief", "news", brief, at, 120)
        rows = rows.select(F.lit(read).alias("read"), F.lit(len(made)).alias("made"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def affinity_restart(spark: SparkSession, d: str) -> DataFrame:
    """Running category weights of a stream of signals that stops and goes on from its checkpoint; the last state."""
    place = scratch(spark, "affinity")
    signals = _signals(spark, d).select("event_id", "user_id", "category", "kind")
    store = Store(spark, f"{place}/store")
    for late in (False, True):
        part = signals.where((F.col("event_id") % 2 == 1) == F.lit(late))
        part.repartition(2, "event_id").write.mode("append").parquet(f"{place}/inbox")
        stream = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/inbox")
        start_affinity(stream, store, f"{place}/checkpoint", None).awaitTermination()
    return affinity_state(store)


def ingest_full_report(spark: SparkSession, d: str) -> DataFrame:
    """A merge of documents as entries beside stories already stored; all keys of its report but the times."""
    store = Store(spark, scratch(spark, "report"))
    entries = _entries(spark, d).withColumns({"excerpt": F.lit(""), "title": F.concat(F.lit("Story "), F.md5("title"))}).withColumns({c: F.lit("") for c in ("coverage_city", "coverage_province")})
    stored = entries.where("published_ts < '2024-04-30 22:30:00'")
    store.replace(dedupe.with_keys(stored.select("pos", "title", "link", F.lit("s").alias("source"), "published_text")))
    sources = entries.groupBy(F.coalesce("registry_key", F.lit("none")).alias("registry_key")).agg((F.min("pos") % 2 == 0).alias("ok"), F.concat(F.lit("stopped at "), F.min("pos")).alias("error"))
    out = ingest.reported_ingest(entries, sources, store, F.lit("2024-05-01 01:00:00").cast("timestamp_ntz"))
    joined = lambda t: t.startswith("array")
    keys = [(k, t) for k, t in ingest.REPORT_KEYS if not k.endswith("seconds")]
    return out.select(*[F.array_join(k, "|").alias(k) if joined(t) else F.col(k) for k, t in keys])


def feed_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as the bodies of FEEDS feeds, fetched as a stream beside one that fails; what each gave."""
    place = scratch(spark, "feeds")
    line = F.regexp_replace(F.coalesce("html", F.lit("")), r"[\r\n]", " ")
    pages = table(spark, d, "pages").select(line.alias("line"), (F.col("page_id") % FEEDS).alias("feed"))
    pages.repartition(FEEDS, "feed").write.partitionBy("feed").text(f"{place}/bodies")
    files = spark.read.text(f"{place}/bodies").select("feed", F.input_file_name().alias("file")).distinct().collect()  # one for each feed
    feeds = [(f"feed-{r['feed']}", r["file"]) for r in files] + [("feed-gone", f"{files[0]['file']}.gone" if files else "file:///gone")]
    spark.dataSource.register(FeedSource)
    rounds = spark.readStream.format("feeds").option("feeds", json.dumps(feeds)).option("timeout", "30").load()
    rounds.writeStream.format("parquet").option("path", f"{place}/fetched").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(SCHEMA).parquet(f"{place}/fetched")
    n_lines = F.length("body") - F.length(F.replace("body", F.lit("\n")))
    return got.select("registry_key", "ok", "stage", F.col("error").isNotNull().alias("failed"), F.coalesce(n_lines, F.lit(0)).alias("n_pages"), F.coalesce(F.length("body"), F.lit(0)).alias("n_chars"))


QUERIES = {f.__name__: f for f in (refresh_cycle, merge_buckets, brief_snapshot, affinity_restart, ingest_full_report, feed_rounds)}

_TITLE_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[–—-]', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_BIT = lambda at: f"('0x' || substr(md5(key), {at}, 8))::BIGINT % 32768"
_FETCH_SQL = ", ".join(f"({k}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, (a, b) in enumerate(FETCHES, 1))
_BRIEF_SQL = """SELECT {read} AS read, {made} AS made, id, round(brief, 3) AS brief_score FROM (
          SELECT id, score + CASE WHEN id % 50 <= 12 THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END AS brief FROM (
            SELECT doc_id AS id, doc_id * 7919 % 1009 / 8.0::DOUBLE AS score FROM documents WHERE {where} ORDER BY score DESC, id DESC LIMIT 80)
          QUALIFY row_number() OVER (PARTITION BY id % 900 ORDER BY score DESC, id DESC) = 1)
        QUALIFY row_number() OVER (ORDER BY brief DESC, id DESC) <= 5"""

ORACLES = {
    "refresh_cycle": f"""WITH n AS (SELECT count(DISTINCT ({_TITLE_KEY}, lower(trim(source)), lang)) FILTER (lang = 'en') AS early, count(DISTINCT ({_TITLE_KEY}, lower(trim(source)), lang)) AS late FROM documents),
        l AS (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20 00:02:00') AS a, count(*) FILTER (ts < TIMESTAMP '2024-01-20 00:03:00') AS b, count(*) FILTER (ts < TIMESTAMP '2024-01-25') AS c,
            count(*) FILTER (ts < TIMESTAMP '2024-01-25 00:02:00') AS e, date_diff('second', max(ts) FILTER (ts < TIMESTAMP '2024-01-20 00:02:00'), TIMESTAMP '2024-01-20 00:03:00') >= 900 AS old FROM events),
        s AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS step, unnest(['cold_start_general', 'read', 'stale_local', CASE WHEN old THEN 'stale_local' ELSE 'read' END, 'stale_local', 'read', 'ingest_general', 'ingest_local']) AS mode,
            unnest([early, early, early, early, early, early, late, late]) AS n_news, unnest([0, 0, a, CASE WHEN old THEN b ELSE a END, c, c, c, e]) AS n_local, unnest([early, early, early, early, early, early, early, early]) AS n_first FROM n, l)
        SELECT step, mode, (count(*) FILTER (mode <> 'read') OVER (ORDER BY step))::BIGINT AS version, n_news, n_local, n_first FROM s""",
    "merge_buckets": f"""WITH f(turn, a, b) AS (VALUES {_FETCH_SQL}),
        e AS (SELECT turn, event_id, event_type || ' ' || user_id AS title, strftime(ts, '%Y-%m-%d') AS day, user_id || '/' || lower(event_type) || '/' || strftime(ts, '%Y-%m-%d') AS k, ts >= a AND ts < b AS here FROM events JOIN f ON ts >= a AND ts < b),
        j AS (SELECT *, min(turn) OVER (PARTITION BY k) < turn AS known, row_number() OVER (PARTITION BY k, turn ORDER BY event_id) = 1 AS first FROM e),
        r AS (SELECT turn, count(*) FILTER (NOT known AND first) AS "new", count(*) FILTER (known) AS stored_link, count(*) FILTER (NOT known AND NOT first) AS batch_duplicate FROM j GROUP BY 1),
        a AS (SELECT DISTINCT turn, unnest(['l:https://e.ca/' || k, 'c:' || substr(sha256(lower(title) || '|s|' || day), 1, 32)]) AS key FROM e),
        p AS (SELECT turn, key, ('0x' || substr(md5(key), 1, 4))::BIGINT % {BUCKETS} AS bucket, [{_BIT(5)}, {_BIT(13)}, {_BIT(21)}] AS bits FROM a),
        t AS (SELECT turn, key, bucket, unnest(bits) AS bit FROM p),
        w AS (SELECT bucket, bit, min(turn) AS since FROM t GROUP BY ALL),
        o AS (SELECT t.turn, key, t.bucket, bool_and(since < t.turn) AS admitted FROM t JOIN w USING (bucket, bit) GROUP BY ALL)
        SELECT turn::INTEGER AS turn, count(DISTINCT bucket)::INTEGER AS buckets_asked, (count(DISTINCT bucket) FILTER (admitted))::INTEGER AS buckets_opened, any_value("new") AS "new", any_value(stored_link) AS stored_link, any_value(batch_duplicate) AS batch_duplicate
        FROM o JOIN r USING (turn) GROUP BY 1""",
    "brief_snapshot": " UNION ALL ".join(f"SELECT * FROM ({_BRIEF_SQL.format(read=read, made=made, where=where)})" for read, made, where in ((1, 1, "true"), (2, 1, "true"), (3, 2, "true"), (4, 3, "lang = 'en'"))),
    "ingest_full_report": f"""WITH {_ENTRIES}, k AS (SELECT * FROM f WHERE first AND home QUALIFY row_number() OVER (ORDER BY ts DESC, pos) <= 150),
        s AS (SELECT DISTINCT 'https://' || CASE WHEN doc_id % 5 = 0 THEN 'www.bbc.com/' ELSE 'cbc.ca/' END || (doc_id % 700) AS key FROM documents WHERE TIMESTAMP '2024-05-01' - to_minutes(doc_id * 37 % 1000) < TIMESTAMP '2024-04-30 22:30:00'),
        n AS (SELECT count(*) AS clustered, count(*) FILTER (key IN (SELECT key FROM s)) AS old, array_to_string((list(key ORDER BY pos) FILTER (key IN (SELECT key FROM s)))[:5], '|') AS olds,
            array_to_string((list(key ORDER BY pos) FILTER (key NOT IN (SELECT key FROM s)))[:5], '|') AS news FROM k),
        r AS (SELECT coalesce(CASE WHEN pos % 9 > 0 THEN lang END, 'none') AS key, min(pos) AS pos FROM e GROUP BY 1),
        c AS (SELECT count(*) AS raw, count(*) FILTER (NOT first) AS again, count(*) FILTER (first AND home) AS home, count(*) FILTER (first AND NOT home) AS away, array_to_string((list(key ORDER BY pos) FILTER (NOT first))[:5], '|') AS agains FROM f),
        x AS (SELECT count(*) AS asked, count(*) FILTER (pos % 2 = 0) AS got, array_to_string((list(key || ': stopped at ' || pos ORDER BY key) FILTER (pos % 2 = 1))[:12], '|') AS bad FROM r)
        SELECT true AS ok, clustered - old AS inserted, '2024-05-01 01:00:00' AS last_ingested_at, asked AS feeds_requested, got AS feeds_fetched, asked - got AS feeds_fetch_failed, coalesce(bad, '') AS failed_feed_samples, raw AS raw_entries,
          least(150, home) AS candidates, clustered, again AS pipeline_skipped_duplicate_link, 0::BIGINT AS pipeline_skipped_duplicate_content_hash, again + old AS skipped_duplicates, again AS skipped_duplicates_pipeline, 0::BIGINT AS merge_skipped_missing_link,
          old AS merge_skipped_duplicate_db_link, 0::BIGINT AS merge_skipped_duplicate_batch_link, 0::BIGINT AS merge_skipped_duplicate_db_content_hash, 0::BIGINT AS merge_skipped_duplicate_batch_content_hash, old AS skipped_duplicates_merge,
          again + old AS skipped_duplicates_total, coalesce(agains, '') AS sample_pipeline_skipped_links, '' AS sample_pipeline_skipped_content_hash, coalesce(olds, '') AS sample_merge_skipped, coalesce(news, '') AS sample_new_links_inserted,
          home AS after_home_filter, away AS filtered_not_home, NULL::VARCHAR AS error FROM n, c, x""",
    "feed_rounds": f"""SELECT 'feed-' || (page_id % {FEEDS}) AS registry_key, true AS ok, 'done' AS stage, false AS failed, count(*)::INTEGER AS n_pages, sum(length(coalesce(html, '')) + 1)::INTEGER AS n_chars FROM pages GROUP BY page_id % {FEEDS}
        UNION ALL SELECT 'feed-gone', false, 'fetch', true, 0, 0""",
    "affinity_restart": f"WITH {_SIGNALS} SELECT * FROM w",
}
