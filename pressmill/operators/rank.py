"""Story scores as column arithmetic, at an explicit ``as_of`` time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import strip
from ..plans.dims import CITY_PROVINCE, PROVINCES

# Weights of the parts of a score.
RECENCY, E_FOLD_H, FRESH_H, FRESH, UNKNOWN_AGE = 44.0, 30.0, 2.0, 10.0, 9.0
COVERAGE, COVERAGE_CAP = 3.2, 14
DIVERSITY, DIVERSITY_CAP = 4.5, 9
IMAGE = 11.0
CATEGORY = (
    ("politics", 18.0),
    ("canada", 14.0),
    ("business", 11.0),
    ("crime", 10.0),
    ("sports", 9.0),
    ("health", 8.0),
    ("technology", 8.0),
    ("entertainment", 6.0),
    ("world", 4.0),
)
CITY_BOOST, PROVINCE_BOOST, NATIONAL_BOOST, SOURCE_BOOST = 92.0, 50.0, 24.0, 38.0
BRIEF_TODAY = 14.0


def age_hours(published: Column, as_of: Column) -> Column:
    """Hours from publication to ``as_of``, 0 for later ones; both are timestamps of the same kind."""
    return F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", published, as_of) / F.lit(3600.0))


def recency(published: Column, as_of: Column) -> Column:
    age = age_hours(published, as_of)
    return F.when(published.isNull(), UNKNOWN_AGE).otherwise(
        F.lit(RECENCY) * F.exp(-age / F.lit(E_FOLD_H)) + F.when(age <= FRESH_H, FRESH).otherwise(0.0)
    )


def coverage(trending: Column) -> Column:
    return F.least(F.greatest(F.coalesce(trending, F.lit(1)), F.lit(1)), F.lit(COVERAGE_CAP)) * F.lit(COVERAGE)


def diversity(n_sources: Column) -> Column:
    return F.least(F.greatest(F.coalesce(n_sources, F.lit(1)), F.lit(1)), F.lit(DIVERSITY_CAP)) * F.lit(DIVERSITY)


def image(url: Column) -> Column:
    return F.when(strip(url) != "", IMAGE).otherwise(0.0)


def category(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    return F.greatest(*[F.when(low.contains(word), boost).otherwise(0.0) for word, boost in CATEGORY])


def rank_parts(published: Column, trending: Column, n_sources: Column, image_url: Column, topic: Column, as_of: Column) -> Column:
    """struct<recency, coverage, diversity, image, category>, each to two places, halves to even."""
    parts = {
        "recency": recency(published, as_of),
        "coverage": coverage(trending),
        "diversity": diversity(n_sources),
        "image": image(image_url),
        "category": category(topic),
    }
    return F.struct(*[F.bround(v, 2).alias(k) for k, v in parts.items()])


def rank_score(parts: Column) -> Column:
    return F.bround(parts["recency"] + parts["coverage"] + parts["diversity"] + parts["image"] + parts["category"], 4)


def strongest_part(parts: Column) -> Column:
    names = ("recency", "coverage", "diversity", "image", "category")
    return F.array_max(F.array(*[F.struct(parts[n].alias("v"), F.lit(n).alias("n")) for n in names]))["n"]


def scaled(score: Column, places: int = 4) -> Column:
    """The score as a whole number, for exact comparison across engines."""
    return F.floor(score * F.lit(10.0**places) + F.lit(0.5)).cast("long")


def province_of(region: Column, city_province: dict[str, str] = CITY_PROVINCE, provinces: tuple[str, ...] = PROVINCES) -> Column:
    r = strip(region)
    known = F.create_map(*[F.lit(x) for pair in city_province.items() for x in pair])
    return F.when(r.isin(*provinces), r).otherwise(known[r])


def location_boost(region: Column, city: str | None, province: str | None, **dims) -> Column:
    """struct<boost, reason> for a reader's place, either part of which may be missing."""
    r, c, p = strip(region), (city or "").strip().lower(), (province or "").strip().lower()
    made = lambda b, why: F.struct(F.lit(b).alias("boost"), F.lit(why).alias("reason"))
    if not c and not p:
        return made(0.0, "no_preference")
    out = F.when(r == "", made(0.0, "empty_region"))
    if c:
        out = out.when(F.lower(r) == c, made(CITY_BOOST, "city_exact"))
    if p:
        out = out.when(F.lower(r) == p, made(PROVINCE_BOOST, "province_exact"))
        out = out.when(F.lower(province_of(region, **dims)) == p, made(PROVINCE_BOOST, "province_via_city"))
    return out.when(r == "Canada", made(NATIONAL_BOOST, "national")).otherwise(made(0.0, "baseline"))


def location_bucket(reason: Column) -> Column:
    """What a boost's reason counts as in a mix of stories."""
    return (
        F.when(reason == "no_preference", "no_preference")
        .when(reason == "city_exact", "local")
        .when(reason.startswith("province"), "province")
        .when(reason == "national", "national")
        .otherwise("other")
    )


def by_place(news, city: str | None, province: str | None, score: str = "rank_score", id_col: str = "id", **dims):
    """``news`` with boost, reason and effective rank, best first."""
    place = location_boost(F.col("region"), city, province, **dims)
    out = news.withColumn("boost", place["boost"]).withColumn("reason", place["reason"])
    out = out.withColumn("effective", F.coalesce(F.col(score), F.lit(0.0)) + F.col("boost"))
    return out.orderBy(F.desc("effective"), F.desc(id_col))


def brief_score(score: Column, published: Column, as_of: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) + F.when(F.to_date(published) == F.to_date(as_of), BRIEF_TODAY).otherwise(0.0)
