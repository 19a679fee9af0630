"""The stored feeds as Parquet, in versions.

Every write goes to a folder of its own; then one small Parquet file under
``versions/v=N`` lists the folders of each table. That file is the pointer: it
appears whole or not at all, so a reader sees version N or N - 1 and never half
a write, and one that holds an older version goes on reading its folders while
a refresh swaps them. There is one writer at a time.

Rows with link_key and content_key bring their keys to a key table of the same
version (``keys``), so a merge opens only the buckets its batch may hit.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import add_summary
from ..operators import dedupe
from ..operators.feed import is_pending
from . import keys

ENTRY = "name string, folder string, changed long, made_from long, made_at timestamp, batch long"


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


class Store:
    """One folder with versions of ``news``, a table for each local scope, ``summary_updates`` and snapshots."""

    def __init__(self, spark: SparkSession, root: str, layout: keys.KeyLayout = keys.KeyLayout()):
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout
        self._known: dict[int, list] = {0: []}

    def version(self) -> int:
        """The newest version; 0 before the first write."""
        try:
            return self.spark.read.schema(f"{ENTRY}, v long").parquet(f"{self.root}/versions").agg(F.max("v")).first()[0] or 0
        except AnalysisException as e:
            if _missing(e):
                return 0
            raise

    def entries(self, at: int | None = None) -> list:
        """The folders of a version, one row each: as many as writes since the last replacement of each table."""
        at = self.version() if at is None else at
        if at not in self._known:
            self._known[at] = self.spark.read.schema(ENTRY).parquet(f"{self.root}/versions/v={at}").collect()
        return self._known[at]

    def has(self, name: str, at: int | None = None) -> bool:
        return any(e.name == name for e in self.entries(at))

    def read(self, name: str = "news", at: int | None = None) -> DataFrame:
        """A table as of a version, the newest by default; columns that older folders lack are null there."""
        folders = [e.folder for e in self.entries(at) if e.name == name]
        if not folders:
            raise ValueError(f"the store has no {name}")
        return self.spark.read.option("mergeSchema", True).parquet(*folders)

    def _write(self, rows: DataFrame, name: str, by: str | None = None) -> str:
        folder = f"{self.root}/data/{name}/w={uuid.uuid4().hex}"
        (rows.repartition(by).write.partitionBy(by) if by else rows.write).parquet(folder)
        return folder

    def _commit(self, added: dict[str, str], whole: bool, made_from: int | None = None, made_at=None, batch: int | None = None) -> int:
        """The next version: ``added`` folders beside those of their tables, or in their place."""
        now = self.version()
        old = [tuple(e) for e in self.entries(now) if not (whole and e.name in added)]
        new = [(name, folder, now + 1, made_from, made_at, batch) for name, folder in added.items()]
        self.spark.createDataFrame(old + new, ENTRY).coalesce(1).write.parquet(f"{self.root}/versions/v={now + 1}")
        return now + 1

    def _with_keys(self, rows: DataFrame, name: str, folder: str) -> dict[str, str]:
        """The folder of a table and those of its keys, where it has any."""
        if not {"link_key", "content_key"} <= set(rows.columns):
            return {name: folder}
        return {name: folder} | self._keys(self.spark.read.parquet(folder), name)

    def _keys(self, rows: DataFrame, name: str) -> dict[str, str]:
        placed = keys.dealt(keys.keys_of(rows), self.layout)
        tables = {"keys": placed.select("bucket", "key"), "filters": keys.filters_of(placed)}
        return {self._key_table(kind, name): self._write(df, kind, "bucket") for kind, df in tables.items()}

    def _key_table(self, kind: str, name: str) -> str:
        return f"{kind}:{self.layout.buckets}x{self.layout.slices}:{name}"

    def index(self, name: str = "news") -> int:
        """Makes the key tables of a table that has none, or those of another layout."""
        rows = self.read(name)
        return self._commit(self._keys(rows if "link_key" in rows.columns else dedupe.with_keys(rows), name), True)

    def append(self, rows: DataFrame, name: str = "news", batch: int | None = None) -> int:
        """Adds rows; the version that has them."""
        return self._commit(self._with_keys(rows, name, self._write(rows, name)), False, batch=batch)

    def replace(self, rows: DataFrame, name: str = "news") -> int:
        """Swaps the whole table and its keys; ``rows`` may read the version before."""
        return self._commit(self._with_keys(rows, name, self._write(rows, name)), True)

    @staticmethod
    def scope(city: str, province: str) -> str:
        return f"news_local/{province}/{city}"

    def replace_scope(self, rows: DataFrame, city: str, province: str) -> int:
        """Swaps the rows of one place and no other."""
        name = self.scope(city, province)
        scoped = rows.withColumns({"scope_province": F.lit(province), "scope_city": F.lit(city)})
        return self._commit({name: self._write(scoped, "news_local")}, True)

    def read_scope(self, city: str, province: str, at: int | None = None) -> DataFrame:
        return self.read(self.scope(city, province), at)

    def look_up(self, asked: DataFrame, name: str = "news") -> keys.Lookup:
        """Which of ``asked`` (key) the table holds."""
        entries, found = self.entries(), []
        for kind, schema in (("keys", "key string, bucket int"), ("filters", "slice int, bitmap binary, bucket int")):
            folders = [e.folder for e in entries if e.name == self._key_table(kind, name)]
            if not folders and any(e.name == name for e in entries):
                raise ValueError(f"{name} has no keys in this layout; index it")
            base = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{kind}")
            found.append(base.parquet(*folders) if folders else None)
        return keys.look_up(asked, *found, self.layout)

    def batches(self, name: str = "news") -> set[int]:
        """The batches that the table has taken in."""
        return {e.batch for e in self.entries() if e.name == name and e.batch is not None}

    def merge(self, batch: DataFrame, name: str = "news", batch_id: int | None = None, found: keys.Lookup | None = None) -> DataFrame:
        """Appends the rows of ``batch`` (with keys and pos) that the table lacks; the counts of each reason.

        Rows, keys and ``batch_id`` appear in one version, so a batch that is
        run again after a failure adds nothing twice. ``batch`` is written before
        it is judged, so its keys are made once. ``found`` is the lookup of
        the keys of a staged batch, where the caller has made it.
        """
        if batch_id is not None and batch_id in self.batches(name):
            return self.spark.createDataFrame([], "reason string, n long")
        judged = self.staged(self.judged(batch if found else self.staged(batch, name), name, found), f"judged-{name}")
        self.append(judged.where("reason = 'new'").drop("reason"), name, batch_id)
        return judged.groupBy("reason").agg(F.count("*").alias("n"))

    def judged(self, batch: DataFrame, name: str = "news", found: keys.Lookup | None = None) -> DataFrame:
        """``batch`` with the reason for which each row would be added or not."""
        found = found or self.look_up(keys.keys_of(batch), name)
        return dedupe.merge_new(batch, keys.split(found.known))

    def staged(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written to a folder of no version, and read again: evaluated once."""
        return self.spark.read.parquet(self._write(rows, f"staged-{name}"))

    def compact(self, name: str = "news") -> int:
        """Writes a table of many folders, and its keys, as one each. Batches taken in so far stay known by their last."""
        last = max(self.batches(name), default=None)
        rows = self.read(name)
        return self._commit(self._with_keys(rows, name, self._write(rows, name)), True, batch=last)

    def snapshot(self, name: str, of: str, make: Callable[[DataFrame], DataFrame], as_of, seconds: int | None = None) -> DataFrame:
        """A result made from table ``of``, kept until that table changes or, where given, until it is ``seconds`` old."""
        entries = self.entries()
        source = max(e.changed for e in entries if e.name == of)
        for e in entries:
            fresh = e.name == f"snapshot/{name}" and e.made_from == source
            if fresh and (seconds is None or (as_of - e.made_at).total_seconds() < seconds):
                return self.spark.read.parquet(e.folder)
        folder = self._write(make(self.read(of)), "snapshot")
        self._commit({f"snapshot/{name}": folder}, True, source, as_of)
        return self.spark.read.parquet(folder)

    def update_summaries(self, updates: DataFrame) -> int:
        """Appends (id, summary, summary_status, updated_at); reads take the last of each id."""
        return self._commit({"summary_updates": self._write(updates, "summary_updates")}, False)

    def with_summaries(self, news: DataFrame) -> DataFrame:
        last = dedupe.latest(self.read("summary_updates"), ["id"], ["updated_at", "summary"]).select(
            F.col("id"), F.col("summary").alias("__s"), F.col("summary_status").alias("__t")
        )
        joined = news.join(last, "id", "left")
        return joined.withColumns({"summary": F.coalesce("__s", "summary"), "summary_status": F.coalesce("__t", "summary_status")}).drop("__s", "__t")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's address in spark.checkpoint.dir, which all executors share; in a temporary one only on a local master without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='pressmill-')}"
    return f"{where.rstrip('/')}/pressmill-{name}-{uuid.uuid4().hex}"


def fill_pending(news: DataFrame, most: int | None = None) -> DataFrame:
    """Summary updates for the pending rows (id, title, excerpt, summary_status), the first ``most`` by id where given."""
    pending = news.where(is_pending(F.col("summary_status")))
    made = add_summary(pending if most is None else pending.orderBy("id").limit(most), "title", "excerpt")
    return made.select("id", "made.summary", F.lit("ready").alias("summary_status"), "made.summary_source")
