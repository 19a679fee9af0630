"""The corpus pipeline: STAGES over the documents table, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.decontam import decontaminate
from pressmill.llm.language import keep_identified
from pressmill.llm.mixing import mixed_documents
from pressmill.llm.neardup import near_duplicates
from pressmill.llm.sharding import assign_shards
from pressmill.llm.shared import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected; null texts and texts without a letter are. Null ids and repeats are judged by text alone; an empty table stays empty."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of least id.

    Of rows that repeat an id the one of least hash over all columns stays, so
    reruns agree; rows with a null id, and null, empty and blank texts, are
    kept. An empty table stays empty.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    repeated = docs.groupBy(F.col("doc_id").alias("__repeated")).agg(F.count("*").alias("n")).where("n > 1 and __repeated is not null")
    if repeated.isEmpty():
        return left
    twice = left["doc_id"] == repeated["__repeated"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(repeated, twice, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
    return left.join(repeated, twice, "left_anti").unionByName(once)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and blank texts hold none, null ids are kept, repeats of an id go together. Empty tables are fine."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for: null sources are a source, null and blank texts get their source's whole copies, equal rows the same number. An empty table stays empty."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard and depth of each row; null texts have 0 bytes, copies of one id share a shard or its parts. An empty table gives an empty result."""
    return assign_shards(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Language models, signatures and fingerprints are not expressible in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return docs
