"""From raw feed entries to stored stories: dedupe, home filter, newest first, cap, pictures, clusters, ranks, merge, and the counts of each step."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import media, naming, text, urls
from ..plans.dims import HOME_REGIONS, PLACEHOLDER_IMAGES
from . import classify, cluster, dedupe, rank

#: Stories of one batch, and those of them whose pages may be fetched for a picture.
BATCH_MAX, PAGE_BUDGET, WARM_UP, SAMPLES = 150, 15, 3, 5


def placeholder_key(category: Column, source: Column, title: Column, link: Column) -> Column:
    return F.concat_ws("|", *[F.lower(F.coalesce(c, F.lit(""))) for c in (category, source, title, link)])


def placeholder_url(key: Column) -> Column:
    return F.get(F.array(*[F.lit(u) for u in PLACEHOLDER_IMAGES]), text.placeholder(key, len(PLACEHOLDER_IMAGES)))


def scanned(feeds: list[DataFrame]) -> DataFrame:
    """Entries of several feeds as one table with pos (feed, entry): the order in which the feeds are listed."""
    out = None
    for turn, feed in enumerate(feeds):
        part = feed.withColumn("pos", F.struct(F.lit(turn).alias("feed"), F.col("entry_pos").alias("entry")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scan_report(fetches: DataFrame, samples: int = 12) -> DataFrame:
    """One row of fetches (registry_key, ok, error): requested, fetched, failed, and the errors of the first failed keys."""
    failed = F.when(~F.col("ok"), F.struct("registry_key", "error"))
    return fetches.agg(
        F.count("*").alias("feeds_requested"),
        F.count_if("ok").alias("feeds_fetched"),
        F.count_if(~F.col("ok")).alias("feeds_failed"),
        F.slice(F.sort_array(F.collect_list(failed)), 1, samples).alias("failed_samples"),  # feeds are a small fixed set
    )


def judged(items: DataFrame, pos: str = "pos") -> DataFrame:
    """``items`` with keys and verdict: kept, duplicate_link, duplicate_content or not_home."""
    keyed = dedupe.with_keys(items)
    kept = dedupe.kept_first(keyed, pos)
    first = kept.where("link_key is not null").select(F.col("link_key").alias("__link"), F.col(pos).alias("__first"))
    alone = kept.where("link_key is null").select(F.col(pos).alias("__alone"))
    # Where a link is kept, its first row is; rows without a link are kept by their place.
    joined = keyed.join(first, F.col("link_key") == F.col("__link"), "left").join(alone, keyed["link_key"].isNull() & (F.col(pos) == F.col("__alone")), "left")
    joined = joined.withColumn("kept", F.coalesce(F.col("__first") == F.col(pos), F.lit(False)) | F.col("__alone").isNotNull()).drop("__alone")
    home = classify.is_home_article(F.col("region"), F.col("link"), HOME_REGIONS)
    verdict = (
        F.when(F.col("kept"), F.when(home, "kept").otherwise("not_home"))
        .when(F.col("__first") < F.col(pos), "duplicate_link")
        .otherwise("duplicate_content")
    )
    return joined.withColumn("verdict", verdict).drop("__link", "__first", "kept")


def batch(verdicts: DataFrame, pos: str = "pos", most: int = BATCH_MAX) -> DataFrame:
    """The newest ``most`` kept rows with their place ``idx`` from 0; equal times in feed order."""
    newest = verdicts.where("verdict = 'kept'").orderBy(F.desc("published_ts"), pos).limit(most)
    return newest.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("published_ts"), pos)) - 1)  # of ``most`` rows


def with_pictures(rows: DataFrame, budget: int = PAGE_BUDGET) -> DataFrame:
    """``rows`` of a batch with their final image_url and image_outcome.

    A feed's own picture comes first; the first ``budget`` rows without one
    take their page's (page_image: struct<url, kind>, resolved: whether the
    link led elsewhere) or their text's (html_image), all else placeholders. A
    picture that an earlier row shows becomes the row's placeholder.
    """
    given = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    own, page, inside = given("image_url", "string"), given("page_image", "struct<url: string, kind: string>"), given("html_image", "string")
    early = F.col("idx") < budget
    made = lambda url, tag: F.struct(url.alias("url"), F.lit(tag).alias("tag") if isinstance(tag, str) else tag.alias("tag"))
    spare = placeholder_url(placeholder_key(F.coalesce(F.nullif(given("topic", "string"), F.lit("")), given("category", "string")), F.col("source"), F.col("title"), F.col("link")))
    first = (
        F.when(urls.is_http(own), made(urls.strip(own), "feed"))
        .when(~early, made(spare, "placeholder_deferred"))
        .when(urls.is_http(page["url"]), made(page["url"], F.when(given("resolved", "boolean"), "og_final_url").otherwise(page["kind"])))
        .when(urls.is_http(inside), made(urls.strip(inside), "html"))
        .otherwise(made(spare, "placeholder"))
    )
    out = rows.withColumn("__spare", spare).withColumn("__first", first).withColumn("__key", F.lower(F.col("__first.url")))
    before = lambda *by: Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    spare_first = F.col("__first.tag").startswith("placeholder")
    out = out.withColumn("__again", ~spare_first & (F.count("*").over(before("__key")) > 0))
    shows_spare = F.count_if(spare_first | F.col("__again")).over(before(F.lower("__spare"))) > 0
    out = out.withColumn("__again", F.col("__again") | (spare_first & shows_spare))
    return (
        out.withColumn("image_url", F.when(F.col("__again"), F.col("__spare")).otherwise(F.col("__first.url")))
        .withColumn("image_outcome", F.when(F.col("__again"), "placeholder_duplicate_image").otherwise(F.col("__first.tag")))
        .drop("__spare", "__first", "__key", "__again")
    )


def report_columns(most: int = BATCH_MAX) -> list[Column]:
    """What entered, what each step took, what is left: aggregates over verdicts."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    kept = of("kept")
    return [
        F.count("*").alias("raw_entries"),
        of("duplicate_link").alias("skipped_duplicate_link"),
        of("duplicate_content").alias("skipped_duplicate_content"),
        (kept + of("not_home")).alias("after_dedupe"),
        kept.alias("after_home_filter"),
        of("not_home").alias("filtered_not_home"),
        F.least(kept, F.lit(most)).alias("candidates"),
    ]


def report(verdicts: DataFrame, most: int = BATCH_MAX) -> DataFrame:
    """One row of ``report_columns``."""
    return verdicts.agg(*report_columns(most))


def samples(verdicts: DataFrame, verdict: str, pos: str = "pos", n: int = SAMPLES) -> DataFrame:
    """The first rows of a verdict: key and title, cut for a log."""
    rows = verdicts.where(F.col("verdict") == verdict).orderBy(pos).limit(n)
    key = F.col("link_key") if verdict == "duplicate_link" else F.col("content_key")
    return rows.select(pos, F.substring(key, 1, 220).alias("key"), F.substring("title", 1, 120).alias("title"), F.substring("source", 1, 80).alias("source"))


def coverage_tier(level: Column) -> Column:
    low = F.lower(urls.strip(level))
    return F.when(low.isin("city", "civic"), "city").when(low.isin("province", "national"), low).otherwise("unknown")


def tier_counts(items: DataFrame) -> DataFrame:
    """Entries for each tier of coverage."""
    return items.groupBy(coverage_tier(F.col("coverage_level")).alias("tier")).agg(F.count("*").alias("n"))


def registry_counts(items: DataFrame) -> DataFrame:
    """Entries for each feed; those without a key as unknown."""
    key = F.coalesce(F.nullif(urls.strip(F.col("registry_key")), F.lit("")), F.lit("unknown"))
    return items.groupBy(key.alias("registry_key")).agg(F.count("*").alias("n"))


def level_counts(items: DataFrame) -> DataFrame:
    """Rows of a batch for each coverage level; those without as legacy."""
    level = F.coalesce(F.nullif(F.lower(urls.strip(F.col("coverage_level"))), F.lit("")), F.lit("legacy"))
    return items.groupBy(level.alias("coverage_level")).agg(F.count("*").alias("n"))


def outcome_counts(pictured: DataFrame) -> DataFrame:
    return pictured.groupBy("image_outcome").agg(F.count("*").alias("n"))


def union_counts(items: DataFrame, edges: dict[str, DataFrame], pos: str = "pos") -> DataFrame:
    """stage, unions: by how much each stage of edges (a, b) lowers the number of components, in order."""
    from .components import components

    spark, total, before, rows, so_far = items.sparkSession, items.count(), None, [], None
    for name, found in edges.items():
        so_far = found if so_far is None else so_far.unionByName(found)
        linked = components(so_far.distinct()).agg(F.count("*") - F.count_distinct("component")).first()[0] or 0
        rows.append((name, linked - (before or 0)))
        before = linked
    return spark.createDataFrame([(*r, total) for r in rows], "stage string, unions long, articles long")


def stories(rows: DataFrame, as_of: Column, vectors: DataFrame | None = None) -> DataFrame:
    """Clustered rows with summary, parts of the score, rank_score and last_updated_at."""
    merged = cluster.cluster_articles(rows, vectors)
    heads = merged.join(rows.select(F.col("link").alias("__l"), "excerpt", "published_text", F.col("pos").alias("__p")), (F.col("link") == F.col("__l")) & (F.col("pos") == F.col("__p")), "left")
    parts = rank.rank_parts(F.col("published_ts"), F.col("trending_score"), F.size("sources"), F.col("image_url"), F.col("topic"), as_of)
    told = text.add_summary(heads.drop("__l", "__p"), "title", "excerpt")
    return (
        told.withColumn("summary", F.col("made.summary"))
        .withColumn("summary_source", F.col("made.summary_source"))
        .withColumn("rank_parts", parts)
        .withColumn("rank_score", rank.rank_score(F.col("rank_parts")))
        .withColumn("last_updated_at", as_of)
        .drop("made")
    )


def ingest(items: DataFrame, as_of: Column, vectors: DataFrame | None = None, most: int = BATCH_MAX) -> tuple[DataFrame, DataFrame]:
    """(stories, report) of raw entries (pos, title, link, source, published_text, published_ts, excerpt, region, topic, coverage, ...)."""
    verdicts = judged(naming.named(items))
    pictured = with_pictures(batch(verdicts, most=most))
    return stories(pictured.drop("idx", "verdict", "link_key", "content_key"), as_of, vectors), report(verdicts, most)


def refresh(store, make: Callable[[tuple[str, str] | None], DataFrame], as_of: Column, place: tuple[str, str] | None = None, forced: bool = False) -> str:
    """Decides what a request of the feed, or of a place (city, province), does with the store, does it, and says which.

    ingest_local and ingest_general: asked for. stale_local: the place has no
    rows or old ones. cold_start_general: the store has no news. read: nothing.
    An ingest takes ``make(place)``, with None for the general feed, and swaps
    the table in a new version; whoever reads an older version goes on with it.
    """
    from .feed import is_stale

    def stale() -> bool:
        return not store.has(store.scope(*place)) or is_stale(store.read_scope(*place), as_of).first()["stale"]

    if forced:
        mode = "ingest_local" if place else "ingest_general"
    elif place and stale():
        mode = "stale_local"
    elif not store.has("news") or store.read("news").isEmpty():
        mode = "cold_start_general"
    else:
        return "read"
    if mode in ("ingest_local", "stale_local"):
        store.replace_scope(make(place), *place)
    else:
        store.replace(make(None))
    return mode


def merge_ingest(items: DataFrame, store, as_of: Column, vectors: DataFrame | None = None, most: int = BATCH_MAX) -> DataFrame:
    """The periodic form: new stories go beside the stored ones; what became of each story, by reason."""
    made, _ = ingest(items, as_of, vectors, most)
    return store.merge(dedupe.with_keys(made))


#: Rows that a report names for each reason, and how much of their text.
REPORT_REASONS = {
    "missing_link": "merge_skipped_missing_link",
    "stored_link": "merge_skipped_duplicate_db_link",
    "batch_link": "merge_skipped_duplicate_batch_link",
    "stored_content": "merge_skipped_duplicate_db_content_hash",
    "batch_content": "merge_skipped_duplicate_batch_content_hash",
}


def batch_reasons(judged_rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows judged by ``merge_new`` with batch_duplicate told apart: batch_link where an earlier new row has the link, else batch_content."""
    first = judged_rows.where("reason = 'new' and link_key is not null").select(F.col("link_key").alias("__link"), F.col(pos).alias("__first"))
    joined = judged_rows.join(first, F.col("link_key") == F.col("__link"), "left")
    told = F.when(F.col("__first") < F.col(pos), "batch_link").otherwise("batch_content")
    return joined.withColumn("reason", F.when(F.col("reason") == "batch_duplicate", told).otherwise(F.col("reason"))).drop("__link", "__first")


def _named_samples(rows: DataFrame, key: str, pos: str = "pos", n: int = SAMPLES) -> list[str]:
    return [r["key"] for r in rows.orderBy(pos).limit(n).select(F.substring(F.coalesce(key, F.lit("")), 1, 220).alias("key")).collect()]


def reported_ingest(items: DataFrame, fetches: DataFrame, store, as_of: Column, vectors: DataFrame | None = None, most: int = BATCH_MAX, name: str = "news") -> DataFrame:
    """The periodic merge with its report as one row, REPORT_KEYS in order.

    ``items`` is read once: the counts of each step are observed while its
    verdicts are written, those of the clusters and of the merge while their
    rows are; samples come from the written tables. ``fetches`` is the scan's
    (registry_key, ok, error). A failure is a report too: ok is false, nothing
    is stored and ``error`` says why.
    """
    spark, began = items.sparkSession, time.monotonic()
    try:
        seen, told, merged = Observation(), Observation(), Observation()
        verdicts = store.staged(judged(naming.named(items)).observe(seen, *report_columns(most)), "verdicts")
        scan = scan_report(fetches).first()
        made = store.staged(dedupe.with_keys(stories(with_pictures(batch(verdicts, most=most)).drop("idx", "verdict", "link_key", "content_key"), as_of, vectors)).observe(told, F.count("*").alias("clustered")), "stories")
        ready = time.monotonic()
        of = lambda r: F.count_if(F.col("reason") == r)
        reasons = store.staged(batch_reasons(store.judged(made, name)).observe(merged, *[of(r).alias(k) for r, k in REPORT_REASONS.items()], of("new").alias("inserted")), "judged")
        store.append(reasons.where("reason = 'new'").drop("reason"), name)
        step, counts = seen.get, merged.get
        pipeline = step["skipped_duplicate_link"] + step["skipped_duplicate_content"]
        at_merge = sum(counts[k] for k in REPORT_REASONS.values())
        values = {
            "ok": True, "inserted": counts["inserted"], "last_ingested_at": str(spark.range(1).select(as_of.cast("string")).first()[0]),
            "feeds_requested": scan["feeds_requested"], "feeds_fetched": scan["feeds_fetched"], "feeds_fetch_failed": scan["feeds_failed"],
            "failed_feed_samples": [f"{x['registry_key']}: {x['error']}" for x in scan["failed_samples"]],
            "raw_entries": step["raw_entries"], "candidates": step["candidates"], "clustered": told.get["clustered"],
            "pipeline_skipped_duplicate_link": step["skipped_duplicate_link"], "pipeline_skipped_duplicate_content_hash": step["skipped_duplicate_content"],
            "skipped_duplicates": pipeline + at_merge, "skipped_duplicates_pipeline": pipeline, **{k: counts[k] for k in REPORT_REASONS.values()},
            "skipped_duplicates_merge": at_merge, "skipped_duplicates_total": pipeline + at_merge,
            "ingestion_time_seconds": round(ready - began, 4), "merge_wall_time_seconds": round(time.monotonic() - ready, 4),
            "sample_pipeline_skipped_links": _named_samples(verdicts.where("verdict = 'duplicate_link'"), "link_key"),
            "sample_pipeline_skipped_content_hash": _named_samples(verdicts.where("verdict = 'duplicate_content'"), "content_key"),
            "sample_merge_skipped": _named_samples(reasons.where("reason != 'new'"), "link_key"),
            "sample_new_links_inserted": _named_samples(reasons.where("reason = 'new'"), "link_key"),
            "after_home_filter": step["after_home_filter"], "filtered_not_home": step["filtered_not_home"], "error": None,
        }
    except (PySparkException, ValueError) as e:
        values = {"ok": False, "inserted": 0, "error": str(e)[:500]}
    return spark.createDataFrame([tuple(values.get(k) for k, _ in REPORT_KEYS)], ", ".join(f"{k} {t}" for k, t in REPORT_KEYS))


REPORT_KEYS = (
    ("ok", "boolean"), ("inserted", "long"), ("last_ingested_at", "string"), ("feeds_requested", "long"), ("feeds_fetched", "long"), ("feeds_fetch_failed", "long"), ("failed_feed_samples", "array<string>"),
    ("raw_entries", "long"), ("candidates", "long"), ("clustered", "long"), ("pipeline_skipped_duplicate_link", "long"), ("pipeline_skipped_duplicate_content_hash", "long"), ("skipped_duplicates", "long"),
    ("skipped_duplicates_pipeline", "long"), *[(k, "long") for k in REPORT_REASONS.values()], ("skipped_duplicates_merge", "long"), ("skipped_duplicates_total", "long"),
    ("ingestion_time_seconds", "double"), ("merge_wall_time_seconds", "double"), ("sample_pipeline_skipped_links", "array<string>"), ("sample_pipeline_skipped_content_hash", "array<string>"),
    ("sample_merge_skipped", "array<string>"), ("sample_new_links_inserted", "array<string>"), ("after_home_filter", "long"), ("filtered_not_home", "long"), ("error", "string"),
)


def warm_up(rows: DataFrame) -> DataFrame:
    """The first stories of the feed, which are prepared ahead."""
    return rows.orderBy(F.desc(F.coalesce("rank_score", F.lit(0.0))), F.desc("id")).limit(WARM_UP)


def html_image(body: Column, link: Column) -> Column:
    """The first picture in an entry's text, made absolute."""
    return media.absolute_url(media.first_image(body), link)
