"""Location-aware order: a tier for each article, then score within the tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import strip
from ..plans.dims import CITY_PROVINCE, PROVINCES
from . import rank


def _low(c: Column) -> Column:
    return F.lower(strip(c))


def region_tier(region: Column, city: str, province: str, hub: str | None, **dims) -> Column:
    """0 city, 1 hub, 2 province, 3 national, 4 none, from the region label alone."""
    r, city, province = strip(region), city.strip().lower(), province.strip().lower()
    return (
        F.when(r == "", 4)
        .when(F.lower(r) == city, 0)
        .when(F.lower(r) == (hub or "").lower() if hub else F.lit(False), 1)
        .when((F.lower(r) == province) | F.coalesce(F.lower(rank.province_of(region, **dims)) == province, F.lit(False)), 2)
        .when(r == "Canada", 3)
        .otherwise(4)
    )


def local_tier(
    region: Column,
    level: Column,
    coverage_city: Column,
    coverage_province: Column,
    city: str,
    province: str,
    hub: str | None = None,
    city_province: dict[str, str] = CITY_PROVINCE,
    provinces: tuple[str, ...] = PROVINCES,
) -> Column:
    """The tier of an article for a reader's (city, province): one cascade, earlier rules win.

    Articles of other provinces and other cities go (4) before any match; then
    the city by label or feed, the hub, the national pool, the province, and
    last the region label alone.
    """
    dims = {"city_province": city_province, "provinces": provinces}
    c, p, h = city.strip().lower(), province.strip().lower(), (hub or "").strip().lower()
    r, rl = strip(region), _low(region)
    own_city, own_level = _low(coverage_city), _low(level)
    of_city = own_level.isin("city", "civic") & (own_city != "") & F.lit(bool(c))
    at_hub = F.lit(bool(h)) & (rl == h)
    home = F.coalesce(F.lower(rank.province_of(region, **dims)), F.lit(""))
    named_city, named_province = r.isin(*city_province), r.isin(*provinces)
    return (
        F.when(F.lit(bool(p)) & named_province & (rl != p), 4)
        .when(F.lit(bool(p)) & (home != "") & (home != p), 4)
        .when(F.lit(bool(c)) & named_city & (rl != c) & ~at_hub, 4)
        .when(F.lit(bool(c)) & (r != "") & (rl == c), 0)
        .when(of_city & (own_city == c), 0)
        .when(of_city, F.when(F.lit(bool(h)) & (own_city == h), 1).otherwise(4))
        .when((r != "") & at_hub, 1)
        .when(
            own_level == "national",
            F.when((rl == "canada") | (r == "") | (r == "Other"), 3).when(named_city | named_province, 4).otherwise(3),
        )
        .when((own_level == "province") & (_low(coverage_province) == p) & F.lit(bool(p)), 2)
        .when(F.lit(bool(p)) & (r != "") & (rl == p), 2)
        .otherwise(region_tier(region, city, province, hub, **dims))
    )


def source_boost(source: Column, region: Column, coverage_city: Column, city: str, hub: str | None, needles: tuple[str, ...], hub_needles: tuple[str, ...] = ()) -> Column:
    """The boost for outlets of the reader's city or its hub."""
    s = F.lower(F.coalesce(source, F.lit("")))
    names = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: s.contains(w)) if words else F.lit(False)
    hit = (_low(coverage_city) == city.strip().lower()) & (_low(coverage_city) != "")
    if hub:
        hit = hit | (_low(coverage_city) == hub.lower()) | (_low(region) == hub.lower()) | names(hub_needles)
    return F.when(hit | names(needles), rank.SOURCE_BOOST).otherwise(0.0)


def is_excluded(region: Column, category: Column) -> Column:
    return (strip(region) == "World") | (_low(category) == "world")


def local_order(df: DataFrame, tier: Column, score: Column, id_col: str = "id") -> DataFrame:
    """Rows of tiers 0 to 3 with ``tier`` and ``local_score``, best first."""
    out = df.withColumn("tier", tier).withColumn("local_score", score).where("tier <= 3")
    return out.orderBy("tier", F.desc("local_score"), F.desc(id_col))


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tier").agg(F.count("*").alias("n"))
