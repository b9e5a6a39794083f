"""A paginated REST API as a Spark data source (``rest_records``): one JSON line for each record.

Options: url, records_path, next_path and cursor_param (cursor pages), page_param (numbered pages, read by
page_tasks tasks up to the first empty one), max_pages (more pages than that are an error), timeout, max_bytes, allow_private. Redirects are followed by hand, and each is checked.
"""

from __future__ import annotations

import itertools
import json
import urllib.error
import urllib.request
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import allowed_url, dig, redact_url


class _Still(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, *, timeout: float, most: int, allow_private: bool, redirects: int = 3) -> bytes:
    opener = urllib.request.build_opener(_Still)
    for _ in range(redirects + 1):
        allowed_url(url, allow_private)
        try:
            with opener.open(url, timeout=timeout) as r:
                body = r.read(most + 1)
                if len(body) > most:
                    raise ValueError(f"more than {most} bytes from {redact_url(url)}")
                return body
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                url = urljoin(url, e.headers["Location"])
                continue
            raise
    raise ValueError("too many redirects")


def with_param(url: str, name: str, value: str) -> str:
    p = urlsplit(url)
    query = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k != name]
    return urlunsplit((p.scheme, p.netloc, p.path, urlencode([*query, (name, value)]), ""))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        tasks = min(int(self.o.get("page_tasks", "8")), int(self.o.get("max_pages", "100")))
        return [InputPartition(i) for i in range(1, tasks + 1)] if self.o.get("page_param") else [InputPartition(0)]

    def read(self, partition):
        o, url = self.o, self.o["url"]
        get = lambda u: json.loads(fetch(u, timeout=float(o.get("timeout", "30")), most=int(o.get("max_bytes", str(256 << 20))), allow_private=o.get("allow_private", "false") == "true"))
        most = int(o.get("max_pages", "100"))
        if partition.value:  # every page_tasks-th page, up to the first empty one
            step = min(int(o.get("page_tasks", "8")), most)
            for number in itertools.count(partition.value, step):
                found = list(self.rows(get(with_param(url, o["page_param"], str(number)))))
                if not found:
                    return
                if number > most:
                    raise ValueError(f"more than max_pages={most} pages at {redact_url(url)}")
                yield from found
        for _ in range(most):
            page = get(url)
            yield from self.rows(page)
            cursor = dig(page, o["next_path"]) if o.get("next_path") else None
            if cursor in (None, ""):
                return
            url = str(cursor) if str(cursor).startswith("http") else with_param(url, o.get("cursor_param", "cursor"), str(cursor))
        raise ValueError(f"more than max_pages={most} pages at {redact_url(o['url'])}")

    def rows(self, page):
        found = dig(page, self.o.get("records_path", ""))
        for record in found if isinstance(found, list) else [] if found is None else [found]:
            yield (json.dumps(record, ensure_ascii=False), redact_url(self.o["url"]))


class RestRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_records"

    def schema(self) -> str:
        return "value string, source string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(RestRecords)
