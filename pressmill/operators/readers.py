"""What readers do: seen and saved stories, category weights, re-ranking, followed topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import client_link, strip
from .classify import FOLLOWED, followed_topics
from .components import ensure_checkpoint_dir
from .dedupe import latest

# How much a signal adds, and the most a category holds.
OPENED, SAVED, SEARCHED, MOST = 2.0, 8.0, 1.5, 200.0
FOR_YOU = 8


def category_key(c: Column) -> Column:
    return F.lower(strip(c))


def affinity(signals: DataFrame) -> DataFrame:
    """(user_id, category, weight) of signals (user_id, category, kind open|save|search); weights stop at MOST."""
    delta = F.when(F.col("kind") == "open", OPENED).when(F.col("kind") == "save", SAVED).when(F.col("kind") == "search", SEARCHED)
    keyed = signals.withColumn("category", category_key(F.col("category"))).withColumn("delta", delta).where("category != '' and delta is not null")
    return keyed.groupBy("user_id", "category").agg(F.least(F.lit(MOST), F.sum("delta")).alias("weight"))


def _substrings(c: Column, longest: int) -> Column:
    """Distinct substrings of three letters up to ``longest``."""
    at = F.sequence(F.lit(1), F.length(c) - 2)
    of = lambda i: F.transform(F.sequence(F.lit(3), F.least(F.lit(max(longest, 3)), F.length(c) - i + 1)), lambda n: F.substr(c, i, n))
    return F.when(F.length(c) >= 3, F.array_distinct(F.flatten(F.transform(at, of))))


def search_interest(searches: DataFrame, categories: DataFrame) -> DataFrame:
    """Search signals: (user_id, search_id, category) where a word of three letters or more and a category contain each other.

    Both ways are joins on equal strings: a word with a category's substrings,
    and a word's substrings, as long as the longest category at most, with categories.
    """
    words = searches.where(F.length(strip(F.col("query"))) >= 2).select(
        "user_id", "search_id", F.explode(F.split(F.lower(strip(F.col("query"))), r"\s+")).alias("word")
    )
    words = words.where(F.length("word") >= 3)
    keys = categories.select(category_key(F.col("category")).alias("category")).where("category != ''").distinct()
    longest = keys.agg(F.max(F.length("category"))).first()[0] or 0
    parts = keys.select("category", F.explode(_substrings(F.col("category"), longest)).alias("word"))
    inside = words.join(parts, "word").select("user_id", "search_id", "category")
    pieces = words.select("user_id", "search_id", F.explode(_substrings(F.col("word"), longest)).alias("category"))
    return inside.unionByName(pieces.join(keys, "category", "left_semi")).distinct()


def rerank(articles: DataFrame, weights: DataFrame, pos: str = "pos") -> DataFrame:
    """Articles of each reader by weight of their category, ties in feed order; adds affinity and place.

    The rows are dealt by ranges of that order, so a reader with very many is
    spread over tasks: a place is the place among the reader's rows of one
    range and the number of those in the ranges before.
    """
    ensure_checkpoint_dir(articles.sparkSession)
    keyed = articles.withColumn("__key", category_key(F.col("category")))
    joined = keyed.join(weights.withColumnRenamed("category", "__key"), ["user_id", "__key"], "left").withColumn(
        "affinity", F.coalesce("weight", F.lit(0.0))
    ).drop("__key", "weight")
    ranged = joined.repartitionByRange("user_id", F.desc("affinity"), pos).withColumn("__range", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy("user_id", "__range").orderBy(F.desc("affinity"), pos)
    earlier = Window.partitionBy("__user").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col("user_id").alias("__user"), F.col("__range").alias("__at")).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    placed = ranged.withColumn("__place", F.row_number().over(own))
    both = placed.join(sizes, (placed["__range"] == sizes["__at"]) & placed["user_id"].eqNullSafe(sizes["__user"]))
    return both.withColumn("place", (F.col("__place") + F.col("__before")).cast("int")).drop("__range", "__user", "__at", "__n", "__before", "__place")


def unseen(articles: DataFrame, seen: DataFrame) -> DataFrame:
    """Articles (user_id, link) whose link the reader hasn't seen."""
    keys = seen.select(F.col("user_id").alias("__u"), client_link(F.col("link")).alias("__l")).distinct()
    return articles.join(keys, (articles["user_id"] == keys["__u"]) & (client_link(articles["link"]) == keys["__l"]), "left_anti")


def saved_latest(events: DataFrame) -> DataFrame:
    """Bookmarks after upserts and removals: the last event of each (user, link) where it saves, newest first."""
    keyed = events.withColumn("__key", client_link(F.col("link")))
    last = latest(keyed, ["user_id", "__key"], ["ts", "event_id"]).drop("__key").where("action = 'save'")
    return last.orderBy(F.desc("ts"), F.desc("event_id"))


def cleared(events: DataFrame, readers: DataFrame) -> DataFrame:
    """Bookmark events without those of readers (user_id) who cleared all."""
    return events.join(readers.select(F.col("user_id").alias("__gone")).distinct(), F.col("user_id") == F.col("__gone"), "left_anti")


def for_you(articles: DataFrame, followed: list[str], pos: str = "pos") -> DataFrame:
    """The eight articles that match most followed topics, ties in feed order."""
    hits = followed_topics(F.col("title"), F.col("summary"), F.col("topic"), F.col("category"))
    own = F.array_intersect(hits, F.array(*[F.lit(f) for f in followed])) if followed else F.array().cast("array<string>")
    return articles.withColumn("matched", own).where(F.size("matched") > 0).orderBy(F.desc(F.size("matched")), pos).limit(FOR_YOU)


def canonical_topics(ids: Column) -> Column:
    """Known topic ids in canonical order, each once."""
    return F.array_intersect(F.array(*[F.lit(t) for t in FOLLOWED]), ids)


def reading_queue(articles: DataFrame, seen: DataFrame, pos: str = "pos") -> DataFrame:
    """All articles, unseen first, each part in feed order; adds is_seen."""
    keys = seen.select(F.col("user_id").alias("__u"), client_link(F.col("link")).alias("__l")).distinct()
    joined = articles.join(keys, (articles["user_id"] == keys["__u"]) & (client_link(articles["link"]) == keys["__l"]), "left")
    return joined.withColumn("is_seen", F.col("__l").isNotNull()).drop("__u", "__l").orderBy("user_id", "is_seen", pos)
