"""Names of outlets and their groups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .urls import strip

UNKNOWN = "Unknown"
# How a label names its group, as (test, words, group); the first that holds wins.
GROUPS = (
    ("starts", ("cbc",), "CBC"),
    ("holds", ("google news",), "Google News"),
    ("starts", ("global news",), "Global News"),
    ("holds", ("reuters",), "Reuters"),
    ("starts", ("bbc",), "BBC"),
    ("holds", ("guardian",), "The Guardian"),
    ("starts", ("ctv",), "CTV News"),
    ("holds", ("national post",), "National Post"),
    ("holds", ("toronto star",), "Toronto Star"),
    ("starts", ("the star",), "Toronto Star"),
    ("holds", ("financial post",), "Financial Post"),
)
# Parts of a broadcaster's story addresses and the desk they name, in order.
DESK_HOST = "cbc.ca"
DESKS = (
    ("/canada/saskatchewan/", "CBC Saskatchewan"),
    ("/canada/manitoba/", "CBC Manitoba"),
    ("/canada/toronto/", "CBC Toronto"),
    ("/canada/montreal/", "CBC Montreal"),
    ("/news/entertainment/", "CBC News"),
)


def source_label(raw: Column) -> Column:
    """What readers see: the feed's name, its first ' - ' made a blank."""
    s = strip(raw)
    at = F.instr(s, " - ")
    joined = strip(F.concat(strip(F.substr(s, F.lit(1), at - 1)), F.lit(" "), strip(F.substr(s, at + 3))))
    return F.when(s == "", UNKNOWN).when(at > 0, joined).otherwise(s)


def source_group(label: Column) -> Column:
    """The publisher behind a label, else the label itself."""
    s = strip(label)
    low, out = F.lower(s), F.when(s == "", UNKNOWN)
    for test, words, group in GROUPS:
        for word in words:
            out = out.when(low.startswith(word) if test == "starts" else low.contains(word), group)
    return out.otherwise(s)


def article_source(link: Column, label: Column) -> Column:
    """The label, unless the story's address names a desk."""
    low = F.lower(F.coalesce(link, F.lit("")))
    out = F.when(~low.contains(DESK_HOST), label)
    for part, desk in DESKS:
        out = out.when(low.contains(part), desk)
    return out.otherwise(label)


def named(df, feed_name: str = "source", link: str = "link"):
    """``df`` with source and source_group as ingested rows carry them."""
    label = source_label(F.col(feed_name))
    return df.withColumn("source", article_source(F.col(link), label)).withColumn("source_group", source_group(F.col("source")))


def topic_label(topic: Column, category: Column) -> Column:
    """The topic, else the category, else empty."""
    return F.when(strip(topic) != "", strip(topic)).otherwise(strip(category))


def page_key(link: Column) -> Column:
    """Key of a fetched page: scheme, host and path without closing slashes; the scheme defaults to https."""
    path = F.regexp_replace(urls.path(link), "/+$", "")
    whole = F.concat(urls.scheme(link), F.lit("://"), urls.authority(link), F.lower(F.when(path == "", F.lit("/")).otherwise(path)))
    return F.when(strip(link) == "", "").when(urls.authority(link) != "", whole).otherwise(F.lower(strip(link)))


def site_icon(link: Column, default: str = "") -> Column:
    """An icon address for the publisher's host."""
    host = urls.raw_authority(link)
    return F.when(host != "", F.concat(F.lit("https://www.google.com/s2/favicons?domain="), host, F.lit("&sz=256"))).otherwise(default)


def preference_key(mode: Column, city: Column, province: Column, code: Column, slug: Column, label: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (mode, city, province, code, slug, label)])
