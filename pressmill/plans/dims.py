"""Static dimensions: fixed values that results depend on, and the tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_SCHEMA = (
    "registry_key string, city string, province string, source_name string, source_group string, feed_url string, "
    "coverage_level string, priority int, active boolean, include_in_general boolean"
)
CITY_SCHEMA = (
    "city string, province string, province_code string, slug string, lat double, lon double, "
    "population_rank int, strong_local_coverage boolean"
)

# Metros, each with a city feed of three publishers.
METROS = (
    ("Ottawa", "Ontario"),
    ("Toronto", "Ontario"),
    ("Montreal", "Quebec"),
    ("Vancouver", "British Columbia"),
    ("Calgary", "Alberta"),
    ("Edmonton", "Alberta"),
    ("Winnipeg", "Manitoba"),
    ("Halifax", "Nova Scotia"),
    ("Regina", "Saskatchewan"),
    ("Saskatoon", "Saskatchewan"),
)
# City feed patterns as (key, label, group, address, priority).
CITY_FEEDS = (
    ("global", "Global News {city}", "Global", "https://globalnews.ca/{slug}/feed/", 10),
    ("cbc", "CBC {city}", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-{slug}", 11),
    ("citynews", "CityNews {city}", "CityNews", "https://{slug}.citynews.ca/feed/", 12),
)
INACTIVE_FEEDS = ("ottawa_cbc_city",)
# Provincial feeds as (key, province, label, group, address, priority).
PROVINCE_FEEDS = (
    ("bc_cbc_province", "British Columbia", "CBC British Columbia", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-britishcolumbia", 20),
    ("ab_cbc_province", "Alberta", "CBC Alberta", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-alberta", 21),
    ("sk_cbc_province", "Saskatchewan", "CBC Saskatchewan", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-saskatchewan", 21),
    ("mb_cbc_province", "Manitoba", "CBC Manitoba", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-manitoba", 20),
    ("on_cbc_province", "Ontario", "CBC Ontario", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-ontario", 22),
    ("on_global_province", "Ontario", "Global News Ontario", "Global", "https://globalnews.ca/ontario/feed/", 23),
    ("qc_cbc_province", "Quebec", "CBC Quebec", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-quebec", 22),
    ("ns_cbc_province", "Nova Scotia", "CBC Nova Scotia", "CBC", "https://www.cbc.ca/webfeed/rss/rss-canada-novascotia", 25),
)
# National feeds as (key, label, group, address, priority).
NATIONAL_FEEDS = (
    ("national_global_top", "Global News - Top Stories", "Global", "https://globalnews.ca/feed/", 100),
    ("national_global_canada", "Global News - Canada", "Global", "https://globalnews.ca/canada/feed/", 101),
    ("national_global_politics", "Global News - Politics", "Global", "https://globalnews.ca/politics/feed/", 102),
    ("national_cbc_top", "CBC News", "CBC", "https://www.cbc.ca/webfeed/rss/rss-topstories", 110),
    ("gnews_canada_general", "Google News — Canada", "Google News", "https://news.google.com/rss/search?q=Canada&hl=en-CA&gl=CA&ceid=CA:en", 95),
    ("gnews_canada_ai", "Google News — Canada AI", "Google News", "https://news.google.com/rss/search?q=Canada+AI&hl=en-CA&gl=CA&ceid=CA:en", 96),
    ("gnews_canada_immigration", "Google News — Canada immigration", "Google News", "https://news.google.com/rss/search?q=Canada+immigration&hl=en-CA&gl=CA&ceid=CA:en", 97),
    ("gnews_canada_housing", "Google News — Canada housing", "Google News", "https://news.google.com/rss/search?q=Canada+housing&hl=en-CA&gl=CA&ceid=CA:en", 98),
    ("gnews_canada_jobs", "Google News — Canada jobs", "Google News", "https://news.google.com/rss/search?q=Canada+jobs&hl=en-CA&gl=CA&ceid=CA:en", 99),
)
# Suburbs and their metro hubs, by letters-only key.
HUBS = {
    "brampton": "Toronto",
    "mississauga": "Toronto",
    "markham": "Toronto",
    "vaughan": "Toronto",
    "oakville": "Toronto",
    "richmondhill": "Toronto",
    "pickering": "Toronto",
    "ajax": "Toronto",
    "oshawa": "Toronto",
    "laval": "Montreal",
    "longueuil": "Montreal",
    "gatineau": "Ottawa",
    "surrey": "Vancouver",
    "coquitlam": "Vancouver",
}
# Province and territory names.
PROVINCES = (
    "Ontario",
    "Quebec",
    "Alberta",
    "British Columbia",
    "Manitoba",
    "Saskatchewan",
    "Nova Scotia",
    "New Brunswick",
    "Prince Edward Island",
    "Newfoundland and Labrador",
    "Yukon",
    "Northwest Territories",
    "Nunavut",
)
CITY_PROVINCE = dict(METROS)
HOME_REGIONS = ("Canada", *CITY_PROVINCE, *PROVINCES)


def source_rows() -> list[tuple]:
    rows = []
    for city, province in METROS:
        slug = city.lower()
        for key, label, group, url, priority in CITY_FEEDS:
            name = f"{slug}_{key}_city"
            rows.append((name, city, province, label.format(city=city), group, url.format(slug=slug), "city", priority, name not in INACTIVE_FEEDS, False))
    rows += [(key, None, province, label, group, url, "province", n, True, True) for key, province, label, group, url, n in PROVINCE_FEEDS]
    rows += [(key, None, "", label, group, url, "national", n, True, True) for key, label, group, url, n in NATIONAL_FEEDS]
    return rows


def sources(spark: SparkSession) -> DataFrame:
    """The feed registry; one row for each feed."""
    return spark.createDataFrame(source_rows(), SOURCE_SCHEMA)


def cities(spark: SparkSession, path: str) -> DataFrame:
    """The city dimension from its JSON file {version, cities: [...]}."""
    raw = spark.read.schema(f"version int, cities array<struct<{', '.join(c.strip().replace(' ', ': ') for c in CITY_SCHEMA.split(','))}>>")
    return raw.option("multiLine", True).json(path).selectExpr("inline(cities)")


def sql_values(rows: list[tuple], columns: str) -> str:
    """Rows as a VALUES list for an oracle."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"

# Pictures shown where a story has none.
PLACEHOLDER_IMAGES = (
    "https://images.unsplash.com/photo-1504711434969-e33886168f5c?auto=format&fit=crop&w=1200&q=60",
    "https://images.unsplash.com/photo-1585829365295-ab7cd400c167?auto=format&fit=crop&w=1200&q=60",
    "https://images.unsplash.com/photo-1495020689067-958852a7765e?auto=format&fit=crop&w=1200&q=60",
    "https://images.unsplash.com/photo-1451187580459-43490279c0fa?auto=format&fit=crop&w=1200&q=60",
)
