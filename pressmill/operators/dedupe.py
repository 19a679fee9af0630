"""Duplicate removal with an explicit input order ``pos``: the first row of a key stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .components import ensure_checkpoint_dir


def with_keys(df: DataFrame, link: str = "link", title: str = "title", source: str = "source", published: str = "published_text") -> DataFrame:
    """Adds link_key (null where blank) and content_key."""
    return df.withColumn("link_key", F.nullif(urls.normalize_link(F.col(link)), F.lit(""))).withColumn(
        "content_key", text.fingerprint(F.col(title), F.col(source), F.col(published))
    )


def first_by(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The row of least ``pos`` for each key. One aggregation on the key, so a hot key is combined before the shuffle."""
    columns = df.columns
    rest = F.struct(F.col(pos).alias("__pos"), *[F.col(c) for c in columns])
    return df.groupBy(key.alias("__key")).agg(F.min_by(rest, F.col(pos)).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in columns])


def dedupe_stable(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Single-key form: by link, or by content where the link is blank. Needs with_keys."""
    return first_by(df, F.coalesce(F.concat(F.lit("l:"), "link_key"), F.concat(F.lit("c:"), "content_key")), pos)


def kept_first(df: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows (pos, link_key, content_key) that ``dedupe_greedy`` keeps.

    Of rows equal in both keys only the first can be kept, and what bars it
    bars the others, so the rounds have one row for each pair of keys. ``df``
    is read once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.groupBy("link_key", "content_key").agg(F.min(pos).alias(pos)).select(pos, "link_key", "content_key").checkpoint()
    again = lambda key: rows.where(f"{key} is not null").groupBy(key).agg(F.count("*").alias(f"n_{key}")).where(f"n_{key} > 1")
    counted = rows.join(again("link_key"), "link_key", "left").join(again("content_key"), "content_key", "left").checkpoint()
    kept = counted.where("n_link_key is null and n_content_key is null").select(rows.columns)
    left = counted.where("n_link_key is not null or n_content_key is not null").select(rows.columns)
    while not left.isEmpty():
        links = left.where("link_key is not null").groupBy("link_key").agg(F.min(pos).alias("first_link"))
        contents = left.groupBy("content_key").agg(F.min(pos).alias("first_content"))
        judged = left.join(links, "link_key", "left").join(contents, "content_key")
        new = judged.where(f"{pos} = first_content and (link_key is null or {pos} = first_link)").select(rows.columns).checkpoint()
        kept = kept.unionByName(new)
        left = (
            left.join(new.select(pos), pos, "left_anti")
            .join(new.where("link_key is not null").select("link_key"), "link_key", "left_anti")
            .join(new.select("content_key").distinct(), "content_key", "left_anti")
            .checkpoint()
        )
    return kept


def dedupe_greedy(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Two-key form: a row goes if an earlier kept row has its link or its content; a dropped row bars nothing.

    Equal to the scan in order of ``pos``. Rows whose keys occur once are kept
    before the rounds. In each round the undecided rows that come first for
    both of their keys are kept, and undecided rows that share a key with them
    go; the first undecided row always is one, so the rounds end, after as many
    as the longest chain of alternating keys. Adds ``kept``; rows without a
    link are judged by content alone.
    """
    return df.join(kept_first(df, pos).select(pos, F.lit(True).alias("__kept")), pos, "left").withColumn("kept", F.coalesce("__kept", F.lit(False))).drop("__kept")


def merge_new(batch: DataFrame, stored: DataFrame, pos: str = "pos") -> DataFrame:
    """``batch`` with a reason for each row: missing_link, stored_link, stored_content, batch_duplicate or new.

    Rows that the store has by link or content can't bar others of the batch.
    Rows equal in both keys are judged as one, by their first.
    """
    ensure_checkpoint_dir(batch.sparkSession)
    links = stored.select(F.col("link_key").alias("__l")).where("__l is not null").distinct()
    contents = stored.select(F.col("content_key").alias("__c")).where("__c is not null").distinct()
    pairs = batch.groupBy("link_key", "content_key").agg(F.min(pos).alias("__first"))
    seen = (
        pairs.join(links, pairs["link_key"] == links["__l"], "left")
        .join(contents, pairs["content_key"] == contents["__c"], "left")
        .withColumn(
            "reason",
            F.when(F.col("link_key").isNull(), "missing_link")
            .when(F.col("__l").isNotNull(), "stored_link")
            .when(F.col("__c").isNotNull(), "stored_content"),
        )
        .drop("__l", "__c")
        .checkpoint()
    )
    new = kept_first(seen.where("reason is null"), "__first").select(F.col("__first").alias("__new"))
    told = seen.join(new, F.col("__first") == F.col("__new"), "left")
    told = told.select(F.coalesce("link_key", F.lit("")).alias("__l"), F.col("content_key").alias("__c"), "reason", F.col("__new").alias("__first"))
    own = batch.join(told, (F.coalesce(batch["link_key"], F.lit("")) == told["__l"]) & batch["content_key"].eqNullSafe(told["__c"]), "left")
    reason = F.coalesce("reason", F.when(F.col(pos) == F.col("__first"), "new").otherwise("batch_duplicate"))
    return own.withColumn("reason", reason).drop("__l", "__c", "__first")


def unique_images(df: DataFrame, image: str, key: Column, placeholder_key: Column, partition: list[str], pos: str = "pos") -> DataFrame:
    """Within a page, a blank or repeated picture becomes the placeholder of the row's key."""
    order = Window.partitionBy(*partition, key).orderBy(pos)
    blank = urls.strip(F.col(image)) == ""
    again = F.row_number().over(order) > 1
    return df.withColumn(
        "image_shown", F.when(blank | again, F.concat(F.lit("placeholder-"), text.placeholder(placeholder_key).cast("string"))).otherwise(F.col(image))
    )


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is last by some columns: bookmark upserts and point updates kept as appends. One aggregation, so hot keys combine first."""
    columns = df.columns
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*[F.col(c) for c in by])).alias("__row")).select("__row.*")


def search_any(term: str, *columns: str) -> Column:
    """Case-insensitive substring test over some columns; an empty term matches nothing."""
    term = term.strip().lower()
    if not term:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(term) for c in columns])
