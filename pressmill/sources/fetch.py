"""A Python data source for feed bodies: one partition for each feed, failures as rows; in batch, or as a stream of rounds.

Reads addresses that urllib can open. Nothing fetches unless this source is
loaded; queries and tests read files.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "registry_key string, ok boolean, stage string, error string, elapsed_ms bigint, body string"


class _Feed(InputPartition):
    def __init__(self, key: str, url: str):
        super().__init__(key)
        self.key, self.url = key, url


def fetch(key: str, url: str, timeout: float) -> tuple:
    """The row of one feed; what goes wrong is part of it."""
    from urllib.request import Request, urlopen

    began = time.monotonic()
    try:
        with urlopen(Request(url, headers={"User-Agent": "pressmill"}), timeout=timeout) as r:
            body = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        return key, True, "done", None, int(1000 * (time.monotonic() - began)), body
    except Exception as e:  # noqa: BLE001  one feed's failure is a row, not the scan's
        return key, False, "fetch", str(e)[:300], int(1000 * (time.monotonic() - began)), None


class _Feeds:
    """Feeds of a scan: each a partition of its own."""

    def __init__(self, options):
        self.feeds = [tuple(f) for f in json.loads(options.get("feeds", "[]"))]
        self.timeout, self.every = float(options.get("timeout", "9")), float(options.get("every", "150"))

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None:  # a scan of no feeds
            yield fetch(partition.key, partition.url, self.timeout)


class _Reader(_Feeds, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Feed(k, u) for k, u in self.feeds]


class _Rounds(_Feeds, DataSourceStreamReader):
    """A stream whose offset is the number of the round that the clock is in, ``every`` seconds each: a batch is one scan of all feeds, and a restart goes on with the next round."""

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Feed(k, u) for k, u in self.feeds] if end["round"] > start["round"] else []


class FeedSource(DataSource):
    """spark.dataSource.register(FeedSource); spark.read (or readStream).format("feeds").option("feeds", json of (key, address)).load()

    Options: feeds, timeout in seconds, and for a stream the seconds of a round (every).
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Rounds(self.options)
