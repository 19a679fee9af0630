"""What the service hands out: pages with their totals, the brief with its reading time, places, and the reader's own view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.naming import topic_label
from ..plans.feedplan import hub_for
from . import dedupe, feed, rank, readers


def display_summary(rows: DataFrame) -> DataFrame:
    """``rows`` with summary as shown: the stored one where ready or failed, else one made from the excerpt; and where it is from."""
    made = text.add_summary(rows, "title", "excerpt", "__made")
    stored = F.lower(urls.strip(F.col("summary_status"))).isin("ready", "failed") & (urls.strip(F.col("summary")) != "")
    shown = F.when(stored, text.clamp(F.col("summary"))).otherwise(F.col("__made.summary"))
    source = F.when(stored, F.lit("stored")).otherwise(F.col("__made.summary_source"))
    return made.withColumn("shown", shown).withColumn("summary_source", source).drop("__made", "summary").withColumnRenamed("shown", "summary")


def envelope(rows: DataFrame, page: int, size: int, order: list[Column], largest: int = feed.PAGE_MAX) -> DataFrame:
    """One page of ``rows`` with total and n_pages beside each; the total is a scalar subquery, not a join."""
    offset, size = feed.page_bounds(page, size, largest)
    total = rows.select(F.count("*").alias("n")).scalar()
    out = rows.orderBy(*order).offset(offset).limit(size)
    return out.withColumn("total", total).withColumn("n_pages", F.ceil(F.col("total") / size).cast("int"))


def page_rows(news: DataFrame, local: DataFrame | None, page: int, size: int, q: str | None = None, largest: int = feed.PAGE_MAX) -> DataFrame:
    """The rows of a page by mode: of a search or all, of the local order (tier, local_score) where given, else of the feed."""
    rows = news if local is None else local
    if q and q.strip():
        rows = feed.search(rows, q)
    order = feed.feed_order() if local is None else [F.col("tier"), F.desc("local_score"), F.desc("id")]
    return envelope(rows, page, size, order, largest)


def brief(news: DataFrame, as_of: Column) -> DataFrame:
    """The daily brief as shown: five stories with summary, label, picture of their own, reading time of all and the newest update."""
    best = display_summary(feed.daily_brief(news, as_of)).withColumn("label", topic_label(F.col("topic"), F.col("category")))
    order = Window.orderBy(F.desc("brief_score"), F.desc("id"))  # of five rows
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "link", "source")])
    placed = best.withColumn("place", F.row_number().over(order)).withColumn("__page", F.lit(0))
    shown = dedupe.unique_images(placed, "image_url", urls.image_key(F.col("image_url")), key, ["__page"], "place")
    whole = Window.partitionBy("__page")
    words = F.size(F.filter(F.split("summary", r"(?U)\s+"), lambda w: w != ""))
    timed = shown.withColumn("read_seconds", text.read_seconds(F.sum(words).over(whole)))
    timed = timed.withColumn("source_timestamp", F.max(F.nullif(urls.strip(F.col("last_updated_at").cast("string")), F.lit(""))).over(whole))
    return timed.withColumn("read_label", text.read_label(F.col("read_seconds"))).drop("__page")


def city_province(cities: DataFrame) -> DataFrame:
    """city, province, province_code, slug, strong_local_coverage for each (city, province) key; of repeats the last (turn) counts."""
    key = [F.lower(urls.strip(F.col(c))) for c in ("city", "province")]
    turn = F.col("turn") if "turn" in cities.columns else F.monotonically_increasing_id()
    kept = F.struct("city", "province", "province_code", "slug", "strong_local_coverage")
    return cities.withColumn("__turn", turn).groupBy(key[0].alias("city_key"), key[1].alias("province_key")).agg(F.max_by(kept, "__turn").alias("place"))


def located(rows: DataFrame, cities: DataFrame, city: str = "city", province: str = "province") -> DataFrame:
    """``rows`` with what is known of their place (null where it isn't) and in_dataset. Cities are a small fixed table."""
    known = city_province(cities)
    on = (F.lower(urls.strip(rows[city])) == known["city_key"]) & (F.lower(urls.strip(rows[province])) == known["province_key"])
    joined = rows.join(known, on, "left").withColumn("in_dataset", F.col("place").isNotNull())
    return joined.withColumn("strong_local_coverage", F.coalesce("place.strong_local_coverage", F.lit(False))).drop("city_key", "province_key")


def enriched(preferences: DataFrame, cities: DataFrame) -> DataFrame:
    """Stored preferences (city, province, province_code, slug, label) filled from the dataset; a blank label becomes the city."""
    out = located(preferences, cities)
    both = (urls.strip(F.col("city")) != "") & (urls.strip(F.col("province")) != "")
    from_place = lambda c: F.when(both & F.col("in_dataset"), F.col(f"place.{c}")).otherwise(F.col(c))
    filled = {c: from_place(c) for c in ("city", "province", "province_code", "slug")}
    label = F.when(both & (F.coalesce("label", F.lit("")) == ""), filled["city"]).otherwise(F.col("label"))
    mode = F.when(both & F.col("in_dataset"), "local").otherwise("general")
    return out.withColumns({**filled, "label": label, "mode": mode}).drop("place", "in_dataset", "strong_local_coverage")


def story_place(region: Column, city: str | None, province: str | None, **dims) -> Column:
    """The line that places a story for a reader: local to the city, the province, Canada, the region; null for none."""
    r = urls.strip(region)
    out = F.when(F.lit(False), "")
    if city:
        out = out.when(F.lower(r) == city.lower(), f"Local to {city}")
    if province:
        out = out.when(rank.province_of(region, **dims) == province, province)
    return out.otherwise(F.nullif(r, F.lit("")))


def city_needles(sources: DataFrame) -> DataFrame:
    """city, needles: the names of each city's active city feeds, sorted."""
    own = sources.where("active and coverage_level in ('city', 'civic') and trim(coalesce(city, '')) != ''")
    return own.groupBy(F.lower(F.trim("city")).alias("city")).agg(F.sort_array(F.collect_set("source_name")).alias("needles"))


def needles_for(sources: DataFrame, city: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The outlet names of a city and of its hub. Sources are a small fixed table."""
    hub = hub_for(city)
    known = {r["city"]: tuple(r["needles"]) for r in city_needles(sources).collect()}
    return known.get(city.strip().lower(), ()), known.get((hub or "").lower(), ())


def needle_hits(rows: DataFrame, needles: tuple[str, ...]) -> DataFrame:
    """One row: stories, and those whose outlet carries one of the names."""
    s = F.lower(F.coalesce("source", F.lit("")))
    hit = F.exists(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: s.contains(n)) if needles else F.lit(False)
    return rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("curated"))


def has_city_tier(sources: DataFrame, city: str) -> DataFrame:
    """One row: whether a list has a city or civic feed for the city."""
    own = F.col("coverage_level").isin("city", "civic") & (F.lower(F.trim(F.coalesce("city", F.lit("")))) == city.strip().lower())
    return sources.agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("has_city_tier"))


def outlet_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with outlets, n_outlets and multi_source."""
    listed = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.col("sources")).otherwise(F.filter(F.array(urls.strip(F.col("source"))), lambda s: s != ""))
    return rows.withColumn("outlets", listed).withColumn("n_outlets", F.size("outlets")).withColumn("multi_source", F.col("n_outlets") > 1)


def client_view(page: DataFrame, weights: DataFrame, topic: str | None = None, term: str | None = None, outlet: str | None = None, pos: str = "pos") -> DataFrame:
    """A reader's page (user_id, pos, ...): repeats out, filtered, by affinity; adds affinity and place."""
    key = F.struct("user_id", F.coalesce(F.concat(F.lit("l:"), F.nullif(urls.client_link(F.col("link")), F.lit(""))), F.concat(F.lit("t:"), text.client_title(F.col("title")))))
    single = dedupe.first_by(page, key, pos)
    return readers.rerank(feed.client_filter(single, topic, term, outlet), weights, pos)


def queue(view: DataFrame, seen: DataFrame, current: str | None, show_seen: bool = False, pos: str = "pos") -> DataFrame:
    """user_id, reason, at, history: where each reader stands in the filtered ``view``.

    With seen stories shown, ``at`` is the current story's place, else 0. Else
    the history is the unseen stories up to the current one, or the first
    unseen alone. Readers of an empty or wholly seen view say so.
    """
    marked = readers.reading_queue(view, seen, pos)
    here = urls.client_link(F.col("link")) == (current or "")
    spots = marked.groupBy("user_id").agg(
        F.min(F.when(here, F.col(pos))).alias("here"),
        F.min(F.when(~F.col("is_seen"), F.col(pos))).alias("first"),
        F.min(F.when(here & ~F.col("is_seen"), F.col(pos))).alias("upto"),
    )
    if show_seen:
        at = marked.join(spots, "user_id").groupBy("user_id").agg(F.count_if(F.col(pos) < F.col("here")).cast("int").alias("at"))
        return at.select("user_id", F.lit("show_seen_browse").alias("reason"), "at", F.array().cast("array<string>").alias("history"))
    walked = marked.where("not is_seen").join(spots, "user_id").where(F.col(pos) <= F.coalesce("upto", "first"))
    history = walked.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("at"), "link"))), lambda r: r["link"]).alias("history"))  # the answer itself
    reason = F.when(F.col("first").isNull(), "no_unseen").when(F.col("upto").isNotNull(), "preserve_unseen_path").otherwise("seed_first_unseen")
    out = spots.join(history, "user_id", "left").withColumn("history", F.coalesce("history", F.array().cast("array<string>")))
    return out.select("user_id", reason.alias("reason"), F.greatest(F.size("history") - 1, F.lit(0)).alias("at"), "history")


def reader_signals(saved: DataFrame, weights: DataFrame) -> DataFrame:
    """user_id, n_saved, has_signal: bookmarks, and whether any category has weight."""
    marks = saved.groupBy("user_id").agg(F.count("*").alias("n_saved"))
    signal = weights.groupBy("user_id").agg(F.bool_or(F.col("weight") > 0).alias("has_signal"))
    both = marks.join(signal, "user_id", "full")
    return both.select("user_id", F.coalesce("n_saved", F.lit(0)).alias("n_saved"), F.coalesce("has_signal", F.lit(False)).alias("has_signal"))


def toggled(followed: Column, topic: Column) -> Column:
    """Followed topics with one taken out if there, else put last."""
    return F.when(F.array_contains(followed, topic), F.array_remove(followed, topic)).otherwise(F.array_append(followed, topic))


def coverage_keys(plan: DataFrame) -> DataFrame:
    """tier, registry_keys of a feed plan's entries, in feed order. Plans are small."""
    names = F.get(F.array(*[F.lit(n) for n in ("city", "metro", "province", "national")]), F.col("tier"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("priority", "registry_key"))), lambda x: x["registry_key"])
    return plan.groupBy(names.alias("tier")).agg(ordered.alias("registry_keys"))
