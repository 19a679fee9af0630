"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are compared after lower-casing A-Z. The first level names a text by its
bytes in UTF-8 and its first HEAD characters; a document alone under that name
has its identity. The others are cut into blocks of BLOCK bytes. The distinct
blocks are sorted and numbered, so each block becomes an integer name; then
adjacent names are paired, the distinct pairs sorted and numbered, and so on
until one name is left of each document. Equal names stand for equal blocks at
every level, no hash decides anything, so texts are equal exactly if their
lengths and last names are.

Distinct blocks and pairs are combined before the shuffle, sorted and numbered
where the shuffle put them (partition number and place in it), and written, so
a lost executor can't renumber them. Names come back by plain equi joins of
written tables, which Spark can split where a block is in a third of the rows.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

BLOCK = 1024
HEAD = 64


def _named(space: Workspace, rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """``rows`` with the integer name of ``keys`` in place of them."""
    names = rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    return space.keep(rows.join(space.keep(names, f"names-{level}"), keys).drop(*keys), f"named-{level}")


def _identities(space: Workspace, rows: DataFrame, block: int) -> DataFrame:
    """row, doc_id, n_bytes, name for each row of ``rows`` (row, doc_id, n_bytes, body): equal n_bytes and name, equal bodies."""
    cut = f"transform(sequence(0, n_left - 1), i -> substring(body, cast(i * {block} + 1 as int), {block}))"
    counted = rows.withColumn("n_left", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block)).cast("int"))
    most = counted.agg(F.max("n_left")).first()[0] or 1
    blocks = counted.select("row", "doc_id", "n_bytes", "n_left", F.posexplode(F.expr(cut)).alias("place", "block"))
    named = _named(space, blocks, ["block"], "0")
    found = [named]
    for level in range(1, (most - 1).bit_length() + 1):
        left = F.col("place") % 2 == 0
        pairs = (
            named.where("n_left > 1")
            .groupBy("row", "doc_id", "n_bytes", F.expr("(n_left + 1) div 2").cast("int").alias("n_left"), F.expr("place div 2").cast("int").alias("place"))
            .agg(F.max(F.when(left, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(-1)).alias("second"))
        )
        named = _named(space, space.keep(pairs, f"pairs-{level}"), ["first", "second"], str(level))
        found.append(named)
    out = None
    for frame in found:
        last = frame.where("n_left = 1").select("row", "doc_id", "n_bytes", "name")
        out = last if out is None else out.unionByName(last)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Of equal texts the row with the largest id stays; of rows that repeat that
    id, one. Null counts as empty, and empty texts are equal to each other.
    Null ids come before all others, so such a row stays only where its whole
    group has none, and keep_id is null then. ``text_sha256`` is of the
    lower-cased text and decides nothing. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "copies")
    lower = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns(
        {"n_bytes": F.octet_length("text").cast("long"), "head": lower(F.substring("text", 1, head))}
    )
    # The heads in question grow with the table, so the plan is the same at every size: both sides are shuffled.
    heads = read.groupBy("n_bytes", "head").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "head", F.lit(True).alias("shared"))
    rows = space.keep(
        read.join(space.keep(heads, "heads").hint("merge"), ["n_bytes", "head"], "left")
        .select("doc_id", "n_bytes", F.coalesce("shared", F.lit(False)).alias("shared"), lower(F.col("text")).alias("text"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_bytes",
            "shared",
            F.sha2("text", 256).alias("text_sha256"),
            F.when(F.col("shared"), F.col("text").cast("binary")).alias("body"),
        ),
        "rows",
    )
    named = _identities(space, rows.where("shared").select("row", "doc_id", "n_bytes", "body"), block)
    groups = named.groupBy("n_bytes", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
    groups = space.keep(groups.select("n_bytes", "name", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row")), "groups")
    judged = named.join(groups, ["n_bytes", "name"]).select("row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = rows.where("not shared").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return alone.select(*out).unionByName(rows.where("shared").join(judged, "row").select(*out))


ORACLE_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
