"""Name -> query and name -> oracle SQL of the feed engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalogue import articles, desk, feeds, library, newsroom


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**feeds.QUERIES, **articles.QUERIES, **newsroom.QUERIES, **desk.QUERIES, **library.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**feeds.ORACLES, **articles.ORACLES, **newsroom.ORACLES, **desk.ORACLES, **library.ORACLES}
