"""Sources over HTTP as Python data sources: JSON lines, and pages that link to the next one.

>>> register(spark); spark.read.format("json_lines_http").option("url", url).load()
"""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def _open(url: str, headers: dict[str, str], timeout: float = 60):
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)  # noqa: S310


def _headers(options: dict[str, str]) -> dict[str, str]:
    """Those of option ``headers`` (a JSON object), and the basic authorization of ``auth`` (user:password)."""
    auth = options.get("auth")
    basic = {"Authorization": f"Basic {base64.b64encode(auth.encode()).decode()}"} if auth else {}
    return json.loads(options.get("headers", "{}")) | basic


def _checked(line: bytes, options: dict[str, str]) -> str | None:
    """A line as text; null for a blank one, or one that isn't JSON unless that is to raise."""
    text = line.decode("utf-8", "replace").strip()
    if not text:
        return None
    try:
        json.loads(text)
    except ValueError:
        if options.get("ignore_errors", "true").lower() == "false":
            raise
        return None
    return text


class _UrlPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class JsonLinesReader(DataSourceReader):
    """One partition a URL; lines that aren't JSON are skipped unless ``ignore_errors`` is false."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_UrlPartition(u) for u in self.options["url"].split()]

    def read(self, partition: _UrlPartition) -> Iterator[tuple[str]]:
        with _open(partition.url, _headers(self.options)) as lines:
            for line in lines:
                if (text := _checked(line, self.options)) is not None:
                    yield (text,)


class JsonLinesStreamReader(SimpleDataSourceStreamReader):
    """Follows one response without an end. A batch is what comes in ``batch_seconds``, ``batch_lines`` lines at most. An
    offset is the number of lines so far: the service is asked for what follows by the query parameter that
    ``offset_param`` names, or else sends all from the start and those lines are passed over."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"line": 0}

    def _lines(self, start: int, most: int, seconds: float) -> list[bytes]:
        url, param = self.options["url"], self.options.get("offset_param")
        if param:
            url += f"{'&' if '?' in url else '?'}{param}={start}"
        out, until, skip = [], time.monotonic() + seconds, 0 if param else start
        try:
            with _open(url, _headers(self.options), seconds) as body:
                while len(out) < most and time.monotonic() < until and (line := body.readline()):
                    if skip:
                        skip -= 1
                    else:
                        out.append(line)
        except TimeoutError:  # a line that isn't whole yet is asked for again
            pass
        return out

    def _rows(self, lines: list[bytes]) -> Iterator[tuple[str]]:
        return iter([(text,) for line in lines if (text := _checked(line, self.options)) is not None])

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        found = self._lines(start["line"], int(self.options.get("batch_lines", 10_000)), float(self.options.get("batch_seconds", 5)))
        return self._rows(found), {"line": start["line"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        n = end["line"] - start["line"]
        found = self._lines(start["line"], n, 60)
        if len(found) < n:
            raise OSError(f"{self.options['url']} has lost lines that were read before: {len(found)} of {n}")
        return self._rows(found)


class JsonLinesHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_lines_http"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return JsonLinesReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return JsonLinesStreamReader(self.options)


class PagedReader(DataSourceReader):
    """Follows next links page by page; each start URL is a partition."""

    def __init__(self, options: dict[str, str], fetch: Callable | None = None):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return [_UrlPartition(u) for u in self.options["url"].split()]

    def read(self, partition: _UrlPartition) -> Iterator[tuple[str]]:
        url = partition.url
        while url:
            with _open(url, _headers(self.options) | {"Accept": "application/json"}) as page:
                body = json.load(page)
            body = body.get("d", body)
            for row in body.get("results", body.get("value", [])) if isinstance(body, dict) else body:
                yield (json.dumps(row),)
            url = (body.get("__next") or body.get("@odata.nextLink")) if isinstance(body, dict) else None


class PagedHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (JsonLinesHttp, PagedHttp):
        spark.dataSource.register(source)
