"""Fetching from several sources: retries, cache, error isolation, feeds, extraction in batches."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import results
from ..session import materialize, shared_dir
from ..sources import feeds
from .config import ProviderError
from .control import FileCache, TokenBucket

logger = logging.getLogger("quarrysift")


def retry(call: Callable, retries: int = 2, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The call's value; it is tried ``retries`` more times, each wait twice the one before."""
    for n in range(retries + 1):
        try:
            return call()
        except Exception as e:
            logger.debug("attempt %d failed, %d left: %s", n + 1, retries - n, e)
            if n == retries:
                raise
            sleep(wait * 2**n)


class Limiters:
    """A token bucket for each name; the first rate asked for counts."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.buckets = clock, {}

    def get(self, name: str, rate: float) -> TokenBucket:
        return self.buckets.setdefault(name, TokenBucket(rate, self.clock))


@dataclass
class Fetched:
    results: DataFrame | None
    errors: list[dict]
    providers: list[str]


def fetch_all(sources: dict[str, Callable[[], DataFrame]], retries: int = 2, cache: FileCache | None = None, key: str = "", concurrency: int = 3, sleep: Callable[[float], None] = time.sleep) -> Fetched:
    """Results of all sources that work, in the sources' order; a failing one becomes an error row.

    A cache holds the path of a written table for each source, in a folder of its own that ``cleanup``
    leaves; a path that can't be read any more is a miss. Empty results are not cached.
    """
    spark = SparkSession.active()

    def held(path: str | None) -> DataFrame | None:
        try:
            return spark.read.parquet(path) if path else None
        except AnalysisException as e:
            logger.info("cached table %s is gone: %s", path, e.getCondition())
            return None

    def one(name: str) -> DataFrame | dict:
        try:
            if cache and (rows := held(cache.get(f"{name}:{key}"))) is not None:
                return rows
            rows = retry(lambda: materialize(sources[name](), f"fetched-{name}"), retries, sleep=sleep)
            if cache and not rows.isEmpty():
                path = f"{shared_dir(spark)}/quarrysift-cache/{uuid.uuid4().hex}"
                rows.write.parquet(path)
                cache.set(f"{name}:{key}", path)
            return rows
        except Exception as e:
            logger.warning("source %s failed: %s", name, e)
            return {"provider": name, "message": str(e)} | ({"statusCode": e.status} if isinstance(e, ProviderError) and e.status else {})

    with ThreadPoolExecutor(concurrency) as pool:
        got = dict(zip(sources, pool.map(one, sources), strict=True))
    good = {n: r for n, r in got.items() if not isinstance(r, dict)}
    return Fetched(results.union_all(list(good.values())) if good else None, [r for r in got.values() if isinstance(r, dict)], list(good))


def healthy(source: Callable[[], DataFrame]) -> bool:
    """Whether a source gives a row or none without failing."""
    try:
        source().limit(1).collect()
        return True
    except Exception:
        return False


@dataclass
class Feeds:
    """Feed addresses, each once, in order of addition."""

    urls: list[str] = field(default_factory=list)

    def add(self, url: str) -> None:
        if url not in self.urls:
            self.urls.append(url)

    def remove(self, url: str) -> None:
        self.urls = [u for u in self.urls if u != url]

    def list(self) -> list[str]:
        return list(self.urls)

    def search(self, query: str, limit: int, read: Callable[[str], DataFrame], as_of: Column) -> DataFrame | None:
        """Items of the feeds that hold a word of the query, feed by feed until ``limit``; failing feeds are skipped.

        ``read`` gives (payload) rows, the XML of a feed.
        """
        parts, have = [], 0
        for place, url in enumerate(self.urls):
            if have >= limit:
                break
            try:
                items = feeds.feed(read(url), as_of)
                fits = items.filter(results.has_any_word(F.concat_ws(" ", "title", "snippet"), query)).orderBy("ord").limit(limit - have)
                rows = materialize(fits.withColumn("ord", F.col("ord") + place * 1_000_000), "feed")
            except Exception as e:
                logger.warning("feed %s failed: %s", url, e)
                continue
            parts.append(rows)
            have += rows.count()
        return results.union_all(parts) if parts else None


def extract_batch(urls: DataFrame, load: Callable[[str], str], together: int = 3) -> DataFrame:
    """(url, html, error) of every row of ``urls`` (url): ``together`` at a time in each task, errors kept by URL."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(url: str) -> tuple[str, str | None, str | None]:
            try:
                return url, load(url), None
            except Exception as e:
                return url, None, str(e)

        with ThreadPoolExecutor(together) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch["url"])), columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")
