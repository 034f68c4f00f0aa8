"""Providers as a Spark data source: one partition fetches from each, and a failing one gives a row that says so."""

from __future__ import annotations

import pickle
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: What a provider gives: (url, title, snippet, time or None) of each result.
Fetch = Callable[[str, int], Iterable[tuple]]
SCHEMA = "provider string, place int, url string, title string, snippet string, ts timestamp, error string, status int"


@dataclass
class ProviderPartition(InputPartition):
    provider: str
    place: int


class ProviderReader(DataSourceReader):
    """Fetches on the executors; a filter on the provider's name leaves the other ones unasked."""

    def __init__(self, fetchers: dict[str, Fetch], options: dict[str, str]):
        self.fetchers, self.names = fetchers, list(fetchers)
        self.query, self.limit = options.get("query", ""), int(options.get("limit", 20))
        self.retries, self.wait = int(options.get("retries", 2)), float(options.get("wait", 1.0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("provider",):
                self.names = [n for n in self.names if n == f.value]
            elif isinstance(f, In) and f.attribute == ("provider",):
                self.names = [n for n in self.names if n in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        every = list(self.fetchers)
        return [ProviderPartition(n, every.index(n)) for n in self.names]

    def read(self, partition: ProviderPartition) -> Iterator[tuple]:
        # all of a provider's rows or none: a failure half-way must not leave some behind; a file holds them until then
        with tempfile.TemporaryFile() as held:
            for attempt in range(self.retries + 1):
                try:
                    held.seek(0)
                    held.truncate()
                    n = 0
                    for row in self.fetchers[partition.provider](self.query, self.limit):
                        pickle.dump(tuple(row), held, pickle.HIGHEST_PROTOCOL)
                        n += 1
                        if n == self.limit:
                            break
                    break
                except Exception as e:
                    if attempt == self.retries:
                        yield partition.provider, -1, None, None, None, None, str(e), getattr(e, "status", None)
                        return
                    time.sleep(self.wait * 2**attempt)
            held.seek(0)
            for place in range(n):
                url, title, snippet, ts = pickle.load(held)
                yield partition.provider, place, url, title, snippet, ts, None, None


def register(spark: SparkSession, fetchers: dict[str, Fetch], name: str = "providers") -> None:
    """Make ``fetchers`` readable as ``spark.read.format(name)``; options: query, limit, retries, wait (seconds, doubled each time).

    They run on the executors, so that each must be picklable; filters are pushed down from then on. The limit goes to the provider, which is read no further.
    """

    class Providers(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return ProviderReader(fetchers, self.options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Providers)


def fetched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (ord by provider and place, url, title, snippet, source, ts) and errors (provider, message, statusCode) of rows read."""
    good = rows.filter("error is null").selectExpr("url", "title", "snippet", "provider as source", "ts", "place")
    bad = rows.filter("error is not null").selectExpr("provider", "error as message", "status as statusCode")
    return good, bad
