"""Connected components of an edge table by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> None:
    """Points checkpoints at spark.checkpoint.dir; a temporary folder only where that is unset and the master is local (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="pressmill-")
        context.setCheckpointDir(where)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least node reachable.

    Each round takes the least label among neighbours, then the label of that
    label, so rounds grow with the logarithm of a chain's length. The labels are
    checkpointed each round; one count comes to the driver.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.selectExpr("a as node", "b as other").unionByName(edges.selectExpr("b as node", "a as other"))
    both = both.where("node != other").distinct().checkpoint()
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")).checkpoint()
    while True:  # labels only fall, so this ends
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("seen")), "other")
            .groupBy("node")
            .agg(F.min("seen").alias("seen"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        after = (
            step.join(jump, "new", "left")
            .select("node", "old", F.least("new", F.coalesce("further", "new")).alias("component"))
            .checkpoint()
        )
        moved = after.where("component != old").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels
