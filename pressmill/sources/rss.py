"""Syndication feeds to article rows. Feeds are fetched apart (a file, a directory or a column of bodies) and parsed in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, media, text, urls
from ..operators import classify

ITEM_SCHEMA = (
    "title string, link string, pubDate string, published string, updated string, description string, summary string, content string, "
    "`content:encoded` string, `media:content` array<struct<_url: string, _type: string, _medium: string, _width: int, _height: int>>, "
    "`media:thumbnail` array<struct<_url: string, _width: int, _height: int>>, "
    "enclosure array<struct<_url: string, _type: string, _length: bigint>>"
)


def read_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items (or entries, with row_tag 'entry') of feed files, with the file's path; malformed ones are dropped."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(ITEM_SCHEMA)
    return reader.load(path).withColumn("feed_path", F.col("_metadata.file_path"))


def items_of(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items and entries of fetched feed bodies with their place entry_pos; other columns stay. Malformed ones and null bodies give no row.

    Each item is parsed alone, so one that is broken, or a body cut short, costs no other.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(r"(?is)<(item|entry)\b[^>]*>.*?</\1\s*>"), F.lit(0))
    rest = [F.col(c) for c in bodies.columns if c != body]
    rows = bodies.select(*rest, F.posexplode(found).alias("entry_pos", "__xml"))
    # Prefixes are declared by the feed, not by the item.
    bare = F.regexp_replace("__xml", r"(?is)^<(?:item|entry)\b[^>]*>", '<item xmlns:media="m" xmlns:content="c" xmlns:dc="d" xmlns:atom="a">')
    bare = F.regexp_replace(bare, r"(?is)</(?:item|entry)\s*>$", "</item>")
    kind = T.StructType([*T._parse_datatype_string(ITEM_SCHEMA).fields, T.StructField("__broken", T.StringType())])
    parsed = rows.withColumn("__item", F.from_xml(bare, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    good = parsed.where("__item is not null and __item.__broken is null")
    href = F.regexp_extract("__xml", r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["']""", 1)  # entries carry links as attributes
    field = lambda name: F.col(f"__item.`{name}`") if name != "link" else F.coalesce(F.nullif(urls.strip(F.col("__item.link")), F.lit("")), text.decoded(href))
    return good.select(*[F.col(c) for c in bodies.columns if c != body], "entry_pos", *[field(f.name).alias(f.name) for f in kind.fields[:-1]])


def _image_items(c: str, typed: bool) -> Column:
    is_image = lambda x: (F.coalesce(x["_medium"], F.lit("")) == "image") | F.coalesce(x["_type"], F.lit("image/")).startswith("image/")
    items = F.filter(F.coalesce(F.col(c), F.array()), is_image) if typed else F.coalesce(F.col(c), F.array())
    return F.transform(items, lambda x: F.struct(x["_url"].alias("url"), x["_width"].alias("width"), x["_height"].alias("height")))


def to_articles(items: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Article rows of items (with registry_key and entry_pos): keys, dates, excerpt, picture, video, region, topic, coverage.

    Items without a link are dropped; the title falls back to the link, a
    missing date to ``as_of``. Sources are a small fixed table.
    """
    it = items.withColumn("link", urls.strip(F.col("link"))).where("link != ''")
    published = F.coalesce(*[F.nullif(urls.strip(F.col(c)), F.lit("")) for c in ("pubDate", "published", "updated")])
    body = F.coalesce(F.col("`content:encoded`"), F.col("content"), F.col("description"), F.col("summary"), F.lit(""))
    enclosed = F.transform(
        F.filter(F.coalesce(F.col("enclosure"), F.array()), lambda x: F.coalesce(x["_type"], F.lit("")).startswith("image/")),
        lambda x: F.struct(x["_url"].alias("url"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")),
    )
    rows = it.select(
        "registry_key",
        "entry_pos",
        F.when(urls.strip(F.col("title")) != "", urls.strip(F.col("title"))).otherwise(F.col("link")).alias("title"),
        "link",
        F.coalesce(published, F.date_format(as_of, "MMM dd, yyyy HH:mm")).alias("published_text"),
        F.coalesce(dates.parse_published(published), as_of).alias("published_ts"),
        F.substring(text.plain(body), 1, 12000).alias("excerpt"),
        F.coalesce(
            media.best_image(_image_items("`media:content`", True)),
            media.best_image(enclosed),
            media.best_image(_image_items("`media:thumbnail`", False)),
            media.first_image(body),
        ).alias("image_url"),
        media.video_url(body).alias("video_url"),
    )
    joined = rows.join(sources.select("registry_key", "source_name", "source_group", "coverage_level", "city", "province"), "registry_key", "left")
    return joined.select(
        F.struct("registry_key", "entry_pos").alias("pos"),
        *rows.columns[2:],
        F.coalesce("source_name", F.lit("Unknown")).alias("source"),
        "source_group",
        "registry_key",
        "coverage_level",
        F.coalesce("city", F.lit("")).alias("coverage_city"),
        F.coalesce("province", F.lit("")).alias("coverage_province"),
        classify.infer_region(F.col("title"), F.col("excerpt")).alias("region"),
        classify.assign_topic(F.col("registry_key"), F.col("source_name"), F.col("link"), F.col("title"), F.col("excerpt"), F.col("coverage_level")).alias("topic"),
    )
