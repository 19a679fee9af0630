"""Periodic merge of arriving articles into the store, as a micro-batch stream.

A batch is judged against the keys that the store holds, opening only the key
buckets it may hit, then appended at once. The batch number is part of the
store's version, so a batch that is run again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedupe, readers
from ..sources.store import Store


def merge_batch(store: Store, name: str = "news"):
    def run(batch: DataFrame, batch_id: int) -> None:
        store.merge(dedupe.with_keys(batch), name, batch_id)

    return run


def start_merge(articles: DataFrame, store: Store, checkpoint: str, every: str | None = "150 seconds", name: str = "news") -> StreamingQuery:
    """Starts the stream; ``every`` None takes all that is there and stops."""
    writer = articles.writeStream.foreachBatch(merge_batch(store, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def start_affinity(signals: DataFrame, store: Store, checkpoint: str, every: str | None = "150 seconds", name: str = "affinity") -> StreamingQuery:
    """Running category weights of a signal stream (user_id, category, kind), in update mode.

    The state holds one sum for each reader and category. A batch's changed
    weights are appended as one version of the store under its number, so a
    stream that goes on from its checkpoint adds no batch twice.
    """

    def keep(changed: DataFrame, batch_id: int) -> None:
        if batch_id not in store.batches(name):
            store.append(changed.withColumn("batch_id", F.lit(batch_id).cast("long")), name, batch_id)

    writer = readers.affinity(signals).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def affinity_state(store: Store, name: str = "affinity") -> DataFrame:
    """The last weight of each reader and category."""
    return dedupe.latest(store.read(name), ["user_id", "category"], ["batch_id"]).drop("batch_id")
