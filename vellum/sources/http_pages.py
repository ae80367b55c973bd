"""Reference pages over HTTP, as a Spark data source: ``spark.read.format("reference_pages").option("url.0", ...)``.

One reader keeps the least time between requests, so it has one partition; crawls of any size should read a stored corpus.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPACING, TIMEOUT = 0.25, 15.0


def get(url: str, timeout: float = TIMEOUT) -> tuple[int, str | None]:
    """(status, body); the body is null unless the status is 200. Redirects are followed."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8")
    except urllib.error.HTTPError as error:
        return error.code, None


class _Reader(DataSourceReader):
    def __init__(self, options):
        self._urls = json.loads(options.get("urls", "[]"))
        self._spacing = float(options.get("spacing", SPACING))
        self._timeout = float(options.get("timeout", TIMEOUT))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        last = 0.0
        for url in self._urls:
            time.sleep(max(0.0, last + self._spacing - time.monotonic()))
            last = time.monotonic()
            status, body = get(url, self._timeout)
            if status not in (200, 404):
                raise OSError(f"{url}: status {status}")
            yield url, status, body


class ReferencePages(DataSource):
    """Options: urls (a JSON array), spacing and timeout in seconds. 404 gives a row without a page, other errors end the read."""

    @classmethod
    def name(cls):
        return "reference_pages"

    def schema(self):
        return "url string, status int, json string"

    def reader(self, schema):
        return _Reader(self.options)


def fetch(spark, urls: list[str], spacing: float = SPACING):
    """(url, status, json) of each url, in turn."""
    spark.dataSource.register(ReferencePages)
    return spark.read.format("reference_pages").option("urls", json.dumps(urls)).option("spacing", str(spacing)).load()


def fetch_corpus(spark, framework: str, symbol: str = "", max_depth: int = 2, fetcher=fetch):
    """(key, json) of a framework's page, or of one symbol's, and of the pages that topic sections lead to within ``max_depth``.

    ``fetcher`` maps the session and a list of urls to (url, status, json); one level after the other is fetched. The
    addresses of a level pass the driver, which is no bound where four pages come in a second. Pages that aren't there are
    left out, and so are links to other sites. References are listed with a page of their own if they were fetched.
    """
    from pyspark.sql import functions as F

    from ..functions import fixed
    from ..operators import reference_pages
    from .scratch import written

    path = f"{framework}/{symbol}".rstrip("/").lower()
    wanted, seen, corpus = {f"{fixed.PAGE_URL}/{path}.json": reference_pages.framework_key(framework, symbol)}, set(), None
    # The root's own links are followed whatever the depth, as a crawl of a stored corpus does.
    for _ in range(1 if symbol else 1 + max(1, max_depth)):
        if not wanted:
            break
        seen |= set(wanted)
        names = spark.createDataFrame(list(wanted.items()), "url string, key string")
        level = written(fetcher(spark, sorted(wanted)).where("json IS NOT NULL").join(names, "url").select("key", "json"), "fetched")
        corpus = level if corpus is None else corpus.union(level)
        children = reference_pages.parsed_pages(level).select(F.explode("page.children").alias("key")).distinct()
        rows = children.select("key", reference_pages.identifier_url(F.col("key")).alias("url")).where("url IS NOT NULL").collect()
        wanted = {r["url"]: r["key"] for r in sorted(rows) if r["url"] not in seen}
    return corpus
