"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of the id. A bucket whose
bytes exceed the limit splits on the next bit, and only such a bucket, until
every shard fits. The directory comes from the bytes of each prefix: all
prefixes down to a depth where buckets are a sixteenth of the limit on average
are summed at once; what is still too large there is carried further, alone.
Rows that agree in all HASH_BITS bits (repeats of an id) are dealt in order
into parts that fit. A row larger than the limit is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

SHARD_BYTES = 64 << 20
#: The query's limit: small enough that buckets split on every table it is run on.
QUERY_BYTES = 256 << 10
HASH_BITS = 60


def prefix_hash(id_col: str, text_col: str) -> Column:
    """HASH_BITS bits as a non-negative long, from md5 of the id, or of the text where the id is null, so that other SQL engines can repeat it."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    digits = F.substring(F.md5(key), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("hash", HASH_BITS - depth)


def _leaves(space: Workspace, rows: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """cell, depth, prefix and over: the shallowest bucket from ``top`` to ``bottom`` that fits, or the one at ``bottom`` that doesn't, of each cell.

    A bucket is a leaf if it fits and its parent doesn't, which two rows at most
    ask of any parent; cells then look for their leaf from the least depth that
    any leaf has.
    """
    cells = space.keep(rows.groupBy(_prefix(bottom).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
    at = F.expr(f"shiftright(cell, {bottom} - depth)").alias("prefix")
    every = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth"))
    sums = space.keep(every.groupBy("depth", at).agg(F.sum("n_bytes").alias("n_bytes")), "sums")
    above = sums.where(F.col("n_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    able = sums.where((F.col("n_bytes") <= limit) | (F.col("depth") == bottom)).withColumn("parent", F.shiftright("prefix", 1))
    split = able.join(above, ["depth", "parent"], "left_semi").unionByName(able.where(F.col("depth") == top))
    leaves = space.keep(split.select("depth", "prefix", (F.col("n_bytes") > limit).alias("over")).distinct(), "leaves")
    least = leaves.agg(F.min("depth")).first()[0]
    own = cells.select("cell", F.explode(F.sequence(F.lit(top if least is None else least), F.lit(bottom))).alias("depth")).withColumn("prefix", at)
    return own.join(leaves, ["depth", "prefix"]).select("cell", "depth", "prefix", "over")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard and depth for each row of ``docs``.

    ``shard`` is the bits of the bucket's prefix, with ``.k`` for part k of
    rows that no bit can part; ``depth`` is the number of bits. Null texts have
    0 bytes; null ids are dealt by their texts. Repeated ids may share a shard or
    fall in parts. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "shards")
    rows = space.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            prefix_hash(id_col, text_col).alias("hash"),
        ),
        "rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    top, step = 0, max(4, math.ceil(math.log2(max(1.0, total / shard_bytes))) + 4)
    found, left = [], rows
    while True:
        bottom = min(HASH_BITS, top + step)
        leaves = _leaves(space, left, top, bottom, shard_bytes)
        placed = space.keep(
            left.withColumn("cell", _prefix(bottom)).join(leaves, "cell").select("doc_id", "n_bytes", "hash", "depth", "prefix", "over"),
            "placed",
        )
        found.append(placed.where("not over"))
        left = placed.where("over").select("doc_id", "n_bytes", "hash")
        if bottom == HASH_BITS or left.isEmpty():
            break
        top, step = bottom, 8
    together = placed.where("over")
    same = Window.partitionBy("hash")
    each = F.greatest(F.lit(1), F.floor(F.lit(float(shard_bytes)) / F.greatest(F.max("n_bytes").over(same), F.lit(1))))
    parts = together.withColumn(
        "part", F.floor((F.row_number().over(same.orderBy("doc_id", "n_bytes")) - 1) / each).cast("string")
    )
    out = parts
    for frame in found:
        out = out.unionByName(frame.withColumn("part", F.lit(None).cast("string")))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')"))
    return out.select(
        "doc_id", "n_bytes", F.concat(bits, F.coalesce(F.concat(F.lit("."), "part"), F.lit(""))).alias("shard"), "depth"
    )


ORACLE_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, {HASH_BITS // 4}))::BIGINT AS hash
  FROM documents),
d AS (SELECT unnest(range(0, 25))::INTEGER AS depth),
s AS (SELECT d.depth, r.hash >> ({HASH_BITS} - d.depth) AS prefix, sum(r.n_bytes) AS n FROM r, d GROUP BY ALL),
leaf AS (
  SELECT r.doc_id, r.n_bytes, r.hash, min(s.depth) AS depth
  FROM r JOIN s ON r.hash >> ({HASH_BITS} - s.depth) = s.prefix
  WHERE s.n <= {QUERY_BYTES} GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hash >> ({HASH_BITS} - depth)), depth, '0') END AS shard, depth
FROM leaf
"""
