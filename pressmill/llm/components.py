"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


EDGES_A_TASK = 50_000


def _stars(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One step over edges (u, v) with u > v; gives edges of the same form.

    Large: every larger neighbour of a node is linked to the least of its
    neighbourhood. Small: the node and its smaller neighbours are, and repeats
    go. ``tasks`` fits the stages to the number of edges, which shrinks, rather
    than to the session's shuffle partitions.
    """
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        around = edges.unionByName(flipped)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        out = flipped.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u != v").coalesce(tasks)
    return out if large else out.distinct().coalesce(tasks)


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the least node reachable.

    Self-links and null ends are ignored; an empty table gives an empty table.
    Rounds grow with the logarithm of the diameter. Each round writes its edges
    to the shared folder; only a count and a checksum come to the driver.
    """
    now = space.keep(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )

    def state(df):
        return df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003)))).first()

    seen = state(now)
    while seen[0]:  # stars settle in as many rounds as the logarithm of the diameter
        tasks = 2 + seen[0] // EDGES_A_TASK
        after = space.keep(_stars(_stars(now, True, tasks), False, tasks), "stars")
        space.drop(now)
        now, before, seen = after, seen, state(after)
        if tuple(seen) == tuple(before):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
