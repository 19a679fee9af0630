"""Reads of the stored feed: pages, search, top k, counts, the brief. Offsets and limits go to the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import dedupe, rank

PAGE_MAX, DB_PAGE_MAX, TOP_MAX = 5, 100, 10
BRIEF_WINDOW, BRIEF_N = 80, 5
FRESH_SECONDS, FRESH_MIN = 900, 60
PUBLIC = (
    "id", "title", "summary", "summary_status", "link", "source", "published_text", "region", "topic", "image_url", "video_url",
    "trending_score", "sources", "related_links",
)
SEARCHED = ("title", "summary", "source", "region", "topic", "category", "source_group", "published_text")


def feed_order(score: str = "rank_score", id_col: str = "id") -> list[Column]:
    return [F.desc(F.coalesce(F.col(score), F.lit(0.0))), F.desc(id_col)]


def page_bounds(page: int | None, size: int | None, largest: int = PAGE_MAX) -> tuple[int, int]:
    """(offset, size) with the page at least 1 and the size from 1 to ``largest``."""
    size = min(max(int(size or largest), 1), largest)
    return (max(int(page or 1), 1) - 1) * size, size


def page_count(total: int, size: int) -> int:
    return math.ceil(total / size) if size > 0 else 0


def feed_page(news: DataFrame, page: int, size: int, score: str = "rank_score", id_col: str = "id", largest: int = PAGE_MAX) -> DataFrame:
    offset, size = page_bounds(page, size, largest)
    return news.orderBy(*feed_order(score, id_col)).offset(offset).limit(size)


def feed_slice(news: DataFrame, offset: int, limit: int, score: str = "rank_score", id_col: str = "id") -> DataFrame:
    """The stored page: limit 1 to 100, offset at least 0."""
    return news.orderBy(*feed_order(score, id_col)).offset(max(0, offset)).limit(min(max(limit, 1), DB_PAGE_MAX))


def feed_top(news: DataFrame, k: int, score: str = "rank_score", id_col: str = "id") -> DataFrame:
    return news.orderBy(*feed_order(score, id_col)).limit(min(max(k, 0), TOP_MAX))


def look_ahead(news: DataFrame, cursor: int, n: int = 2, score: str = "rank_score", id_col: str = "id") -> DataFrame:
    return news.orderBy(*feed_order(score, id_col)).offset(cursor + 1).limit(n)


def search(news: DataFrame, q: str | None, other: str | None = None, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    term = (q or "").strip() or (other or "").strip()
    return news.where(dedupe.search_any(term, *[c for c in columns if c in news.columns]))


def is_pending(status: Column) -> Column:
    s = F.lower(urls.strip(status))
    return (s == "") | (s == "pending")


def counts(news: DataFrame, id_col: str = "id", status: str = "summary_status", updated: str = "last_updated_at") -> DataFrame:
    """n_rows, max_id, n_pending and last_updated of a feed, in one pass."""
    return news.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.max(id_col), F.lit(0)).alias("max_id"),
        F.count_if(is_pending(F.col(status))).alias("n_pending"),
        F.max(updated).alias("last_updated"),
    )


def is_stale(scope: DataFrame, as_of: Column, updated: str = "last_updated_at", max_age: int = FRESH_SECONDS) -> DataFrame:
    """One row: whether a scope is empty or its newest row older than the limit."""
    age = F.timestamp_diff("SECOND", F.max(updated), as_of)
    return scope.agg((F.max(updated).isNull() | (age >= max(FRESH_MIN, max_age))).alias("stale"))


def public_view(rows: DataFrame) -> DataFrame:
    """The public columns with a display summary: the stored one where ready, else one made from the excerpt."""
    ready = F.lower(urls.strip(F.col("summary_status"))).isin("ready", "failed") & (urls.strip(F.col("summary")) != "")
    shown = F.when(ready, text.clamp(F.col("summary"))).otherwise(F.col("made.summary"))
    return text.add_summary(rows, "title", "excerpt").withColumn("summary", shown).select(*[c for c in PUBLIC if c in rows.columns or c == "summary"])


def daily_brief(news: DataFrame, as_of: Column, pos: str = "id") -> DataFrame:
    """The five best of the first 80 by feed order, without repeats, today's first by a bonus."""
    window = news.orderBy(*feed_order()).limit(BRIEF_WINDOW).withColumn("place", -F.coalesce("rank_score", F.lit(0.0)))
    window = dedupe.with_keys(window)
    key = F.coalesce(F.concat(F.lit("l:"), "link_key"), F.concat(F.lit("c:"), "content_key"))
    single = window.withColumn("__order", F.struct("place", -F.col(pos))).groupBy(key.alias("__key")).agg(
        F.min_by(F.struct(*[F.col(c) for c in news.columns]), "__order").alias("r")
    ).select("r.*")
    return single.withColumn("brief_score", rank.brief_score(F.col("rank_score"), F.col("published_ts"), as_of)).orderBy(
        F.desc("brief_score"), F.desc(pos)
    ).limit(BRIEF_N)


def facets(news: DataFrame, topic: str = "topic", source: str = "source", sources: str = "sources") -> DataFrame:
    """(kind, value): distinct topics and outlets, binary order."""
    topics = news.select(F.lit("topic").alias("kind"), urls.strip(F.col(topic)).alias("value"))
    listed = F.when(F.size(F.coalesce(F.col(sources), F.array())) > 0, F.col(sources)).otherwise(F.array(F.col(source)))
    outlets = news.select(F.lit("source").alias("kind"), F.explode(listed).alias("value")).withColumn("value", urls.strip(F.col("value")))
    return topics.unionByName(outlets).where("value != ''").distinct()


def outlets(sources: str = "sources", source: str = "source") -> Column:
    """A story's outlets: its list, else its one source."""
    return F.when(F.size(F.coalesce(F.col(sources), F.array())) > 0, F.col(sources)).otherwise(F.array(F.col(source)))


def client_filter(news: DataFrame, topic: str | None = None, term: str | None = None, outlet: str | None = None) -> DataFrame:
    """The reader's filter: topic (else category), any outlet, and free text over joined columns."""
    out = news
    label = F.coalesce(*[F.col(c) for c in ("topic", "category") if c in news.columns], F.lit(""))
    if topic and topic != "All":
        out = out.where(label == topic)
    if outlet and outlet != "All":
        out = out.where(F.exists(outlets(), lambda s: urls.strip(s) == outlet.strip()))
    if term and term.strip():
        of = [F.col(c) for c in ("title", "summary", "category", "region", "source") if c in news.columns]
        parts = F.concat(F.array(*of), F.coalesce(F.col("sources"), F.array()))
        hay = F.lower(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " "))
        out = out.where(hay.contains(term.strip().lower()))
    return out


def suggest(cities: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """City suggestions: prefix before substring, larger before smaller; by population for an empty query."""
    term = q.strip().lower()
    rank_ = F.coalesce(F.col("population_rank"), F.lit(999))
    if not term:
        return cities.withColumn("score", F.lit(0.0)).orderBy(rank_, "city").limit(limit)
    city, prov, code = F.lower("city"), F.lower("province"), F.lower("province_code")
    graded = lambda c, first, inside: F.when(c.startswith(term), first).when(c.contains(term), inside).otherwise(0)
    score = (
        graded(city, 100000, 50000)
        + graded(prov, 30000, 15000)
        + F.when(code.startswith(term), 25000).otherwise(0)
        + F.greatest(F.lit(0), 500 - rank_)
        - F.ascii(city) / 1000.0
    )
    hit = F.concat_ws(" ", city, prov, code).contains(term)
    return cities.where(hit).withColumn("score", score).where("score >= 0").orderBy(F.desc("score"), "city").limit(limit)
