"""Pages by HTTP, as a Python data source: a partition for each range of addresses, tried again on passing errors. What
can't be had comes as a row with its error, for the dead letters."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGAIN = (500, 502, 503, 504)


def page_urls(form: str, first: date, last: date, editions: tuple[str, ...] = ("am", "pm")) -> list[str]:
    """Addresses of the pages of each day and edition; form has {day} (yyyymmdd) and {edition}."""
    days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    return [form.format(day=f"{d:%Y%m%d}", edition=e) for d in days for e in editions]


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options["urls"])
        self.each = int(options.get("urlsperpartition", 50))
        self.tries, self.timeout, self.wait = int(options.get("tries", 3)), float(options.get("timeout", 30)), float(options.get("wait", 0.5))

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[k : k + self.each]) for k in range(0, len(self.urls), self.each)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield self._get(url)

    def _get(self, url: str) -> tuple:
        status, error = None, None
        for n in range(self.tries):
            if n:
                time.sleep(self.wait * 2 ** (n - 1))
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as got:  # noqa: S310
                    return url, got.status or 200, got.headers.get("Content-Type"), got.read(), None
            except urllib.error.HTTPError as e:
                status, error = e.code, str(e)
                if e.code not in AGAIN:
                    break
            except OSError as e:
                error = str(e)
        return url, status, None, None, error


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("pages").option("urls", json.dumps([...])).load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, content_type string, body binary, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})
