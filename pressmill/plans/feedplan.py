"""Which feeds a reader's place draws on: the registry joined with (city, hub, province), best tier first."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dims import CITY_FEEDS, HUBS


def hub_for(city: str | None) -> str | None:
    """The metro hub of a suburb; None for a hub itself and for unknown places."""
    raw = (city or "").strip()
    hub = HUBS.get(re.sub(r"[^a-z]+", "", raw.lower()))
    return hub if hub and hub.lower() != raw.lower() else None


def city_slug(city: str) -> str:
    """Dashed form of a city's name for feed addresses."""
    return re.sub(r"[^a-z0-9]+", "-", city.strip().lower()).strip("-")


@dataclass(frozen=True)
class FeedPlan:
    city: str
    province: str
    hub: str | None
    entries: DataFrame

    def fallback_type(self) -> str:
        """exact_city, metro_fallback, province_fallback or national_only, by the best tier with a feed."""
        best = self.entries.agg(F.min("tier")).first()[0]
        return {0: "exact_city", 1: "metro_fallback", 2: "province_fallback"}.get(best, "national_only")

    def coverage(self) -> DataFrame:
        """The plan's registry keys for each tier, as one row."""
        by_tier = [
            F.sort_array(F.collect_list(F.when(F.col("tier") == t, F.col("registry_key")))).alias(n)
            for t, n in enumerate(("city", "metro", "province", "national"))
        ]
        return self.entries.agg(*by_tier)


def scoped_entries(sources: DataFrame, city: str, province: str) -> DataFrame:
    """Active sources for a place with their tier, first of each address, in feed order."""
    city, province, hub = city.strip().lower(), province.strip().lower(), hub_for(city)
    at = lambda c, v: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == F.lit(v)
    tier = (
        F.when((F.col("coverage_level") == "city") & at("city", city) & at("province", province), 0)
        .when((F.col("coverage_level") == "city") & (at("city", hub.lower()) if hub else F.lit(False)), 1)
        .when((F.col("coverage_level") == "province") & at("province", province), 2)
        .when(F.col("coverage_level") == "national", 3)
    )
    scoped = sources.where("active").withColumn("tier", tier).where("tier is not null")
    url = F.trim("feed_url")
    first = Window.partitionBy(url).orderBy("tier", "priority", "registry_key")
    return scoped.where(url != "").withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")


def pattern_entries(sources: DataFrame, city: str, province: str) -> DataFrame:
    """City feeds guessed from the address patterns, for a well covered city that the registry lacks."""
    slug = city_slug(city)
    rows = [
        (f"{slug}_{k}_pattern", city, province, label.format(city=city), group, url.format(slug=slug), "city", n, True, False)
        for k, label, group, url, n in CITY_FEEDS
    ]
    return sources.sparkSession.createDataFrame(rows, sources.schema)


def feed_plan(sources: DataFrame, city: str, province: str, strong_local_coverage: bool = False) -> FeedPlan:
    known = sources.where((F.lower("city") == city.strip().lower()) & F.col("active"))
    if strong_local_coverage and known.isEmpty():
        sources = sources.unionByName(pattern_entries(sources, city, province))
    return FeedPlan(city, province, hub_for(city), scoped_entries(sources, city, province))


def general_entries(sources: DataFrame) -> DataFrame:
    """The general pool: active national and regional feeds."""
    return sources.where("active and include_in_general").orderBy("priority", "registry_key")


def registry_stats(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count("*").alias("defined"), F.count_if("active").alias("active"), F.count_if(F.col("active") & F.col("include_in_general")).alias("general")
    )
