"""A data source for platforms that answer in JSON pages: ``spark.read.format("scriptorium-api")``.

One partition reads one route to its end: each page names the next one, in
``links.next`` or by ``meta.page`` (offset, limit, total). Calls that the network
fails are tried again after a while; an answer of the server is a row with its
status, whatever it is. The streaming form reads every route anew with each
offset, and gives only pages whose content has changed since.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "route string, page int, status int, body string"
#: Seconds before a call is tried again.
RETRY_AFTER = (5.0, 20.0)


class _Route(InputPartition):
    def __init__(self, value: str):
        super().__init__(value)


def call(url: str, headers: dict[str, str], *, timeout: float, retries: tuple[float, ...] = RETRY_AFTER) -> tuple[int, str]:
    """Status and body of one address; 599 where it cannot be reached, however often it is tried."""
    for wait in (*retries, None):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as reply:
                return reply.status, reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as fault:
            with fault:
                return fault.code, fault.read().decode("utf-8", "replace")
        except OSError as fault:
            if wait is None:
                return 599, str(fault)
            time.sleep(wait)
    raise AssertionError


def following(url: str, body: str) -> str | None:
    """The address of the page behind one, None at the end."""
    try:
        told = json.loads(body)
    except ValueError:
        return None
    if not isinstance(told, dict):
        return None
    link = (told.get("links") or {}).get("next") if isinstance(told.get("links"), dict) else None
    link = link.get("href") if isinstance(link, dict) else link
    if link:
        return urljoin(url, link)
    page = (told.get("meta") or {}).get("page") if isinstance(told.get("meta"), dict) else None
    if isinstance(page, dict) and all(isinstance(page.get(k), int) for k in ("offset", "limit", "total")) and page["limit"] > 0 and page["offset"] + page["limit"] < page["total"]:
        parts = urlsplit(url)
        query = dict(parse_qsl(parts.query)) | {"page[offset]": page["offset"] + page["limit"], "page[limit]": page["limit"]}
        return urlunsplit(parts._replace(query=urlencode(query)))
    return None


class ApiReader(DataSourceReader):
    """All pages of the routes that the options name."""

    def __init__(self, options: dict[str, str]):
        self.base = options["base"].rstrip("/")
        self.routes = json.loads(options["routes"])
        self.headers = json.loads(options.get("headers", "{}"))
        self.timeout = float(options.get("timeout", 120))
        self.retries = tuple(json.loads(options.get("retries", json.dumps(RETRY_AFTER))))

    def partitions(self) -> list[InputPartition]:
        return [_Route(r) for r in self.routes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url, seen, page = self.base + partition.value, set(), 0
        while url and url not in seen:  # a server may lead in a circle
            seen.add(url)
            status, body = call(url, self.headers, timeout=self.timeout, retries=self.retries)
            yield partition.value, page, status, body
            url, page = (following(url, body) if status < 400 else None), page + 1


class ApiStream(DataSourceStreamReader):
    """The same as a stream: an offset is a look at all routes, told by a digest of what was seen."""

    def __init__(self, options: dict[str, str]):
        self.reader = ApiReader(options)

    def initialOffset(self) -> dict:
        return {"look": 0, "digest": ""}

    def latestOffset(self) -> dict:
        digest = hashlib.sha256()
        for p in self.reader.partitions():  # only the first page of a route: it tells whether there is anything new
            status, body = call(self.reader.base + p.value, self.reader.headers, timeout=self.reader.timeout, retries=self.reader.retries)
            digest.update(f"{p.value} {status} {body}\n".encode())
        return {"look": 0, "digest": digest.hexdigest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start["digest"] == end["digest"] else self.reader.partitions()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.reader.read(partition)


class ApiSource(DataSource):
    """Options: ``base``, ``routes`` (a JSON list), and ``headers``, ``timeout``, ``retries``."""

    @classmethod
    def name(cls) -> str:
        return "scriptorium-api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ApiReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ApiStream(self.options)


def read_pages(spark: SparkSession, base: str, routes: list[str], headers: dict[str, str] | None = None, **options: object):
    """(route, page, status, body): every page of every route, a task a route."""
    spark.dataSource.register(ApiSource)
    told = {"base": base, "routes": json.dumps(routes), "headers": json.dumps(headers or {}), **{k: json.dumps(v) for k, v in options.items()}}
    return spark.read.format("scriptorium-api").options(**told).load()
