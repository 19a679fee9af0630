"""The driver's tables as the engine's notions, in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories, line items as merged articles, suppliers as outlets."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    merged = l.groupBy("l_orderkey").agg(F.count("*").alias("trending"), F.count_distinct("l_suppkey").alias("n_sources"))
    return o.join(merged, o["o_orderkey"] == merged["l_orderkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_ts"), "trending", "n_sources", "o_orderpriority", "o_orderstatus", "o_custkey"
    )


STORIES_SQL = """
s AS (SELECT o.o_orderkey AS id, o.o_orderdate AS published_ts, count(*) AS trending, count(DISTINCT l.l_suppkey) AS n_sources,
             o.o_orderpriority, o.o_orderstatus, o.o_custkey
      FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY ALL)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as articles of a city (nation) in a province (region), with a coverage level from the key."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    kind = F.col("c_custkey") % 5
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.when(kind == 0, F.col("r_name")).when(kind == 1, F.lit("Canada")).when(kind == 2, F.lit("")).otherwise(F.col("n_name")).alias("region"),
        F.when(kind == 2, "national").when(kind == 3, "city").when(kind == 4, "province").otherwise("").alias("coverage_level"),
        F.when(kind == 3, F.col("n_name")).otherwise("").alias("coverage_city"),
        F.when(kind == 4, F.col("r_name")).otherwise("").alias("coverage_province"),
        F.col("c_acctbal").alias("rank_score"),
        F.col("c_mktsegment").alias("source"),
    )


PLACES_SQL = """
p AS (SELECT c_custkey AS id,
             CASE c_custkey % 5 WHEN 0 THEN r_name WHEN 1 THEN 'Canada' WHEN 2 THEN '' ELSE n_name END AS region,
             CASE c_custkey % 5 WHEN 2 THEN 'national' WHEN 3 THEN 'city' WHEN 4 THEN 'province' ELSE '' END AS coverage_level,
             CASE WHEN c_custkey % 5 = 3 THEN n_name ELSE '' END AS coverage_city,
             CASE WHEN c_custkey % 5 = 4 THEN r_name ELSE '' END AS coverage_province,
             c_acctbal AS rank_score, c_mktsegment AS source
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
