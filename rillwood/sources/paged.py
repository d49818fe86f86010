"""A table behind a paged HTTP service, read side by side: partitions come from its count, filters and columns go to it.

>>> register(spark)
>>> spark.read.format("paged_table").schema("id long, name string").option("url", url).option("order", "id").load().filter("id > 7")
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import urllib.parse
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from .http import _headers, _open

#: Fixed words of the query language.
_COMPARE = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
_WORDS = {StringStartsWith: "startswith", StringEndsWith: "endswith", StringContains: "contains"}


def literal(value) -> str | None:
    """A value in the query language; nothing for one that it can't be sure to compare as Spark does."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return None


def condition(f: Filter) -> str | None:
    """A filter in the query language; nothing where it has no word for it."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNotNull):
        return f"{name} ne null"
    if isinstance(f, In):
        found = [literal(v) for v in f.value]
        return "(" + " or ".join(f"{name} eq {v}" for v in found) + ")" if found and None not in found else None
    value = literal(f.value) if type(f) in _COMPARE or type(f) in _WORDS else None
    if value is None:
        return None
    return f"{name} {_COMPARE[type(f)]} {value}" if type(f) in _COMPARE else f"{_WORDS[type(f)]}({name}, {value})"


def converted(value, kind: T.DataType):
    """A JSON value as one of the declared type; null where it can't be."""
    if value is None:
        return None
    try:
        if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return int(value)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value))
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else str(value).lower() == "true"
        if isinstance(kind, T.TimestampType):
            return datetime.datetime.fromisoformat(value)
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(value[:10])
    except (ValueError, TypeError, decimal.InvalidOperation):
        return None
    return value if isinstance(value, str) else json.dumps(value)


class _Range(InputPartition):
    def __init__(self, skip: int, top: int):
        self.skip, self.top = skip, top


class PagedTableReader(DataSourceReader):
    """Options: ``url`` of the collection, ``order`` (a column that orders it, so that pages don't overlap), ``page_rows`` to ask
    for at a time (1000) and ``partition_rows`` (10 pages), ``headers`` and ``auth`` as for the other HTTP sources. Only the
    columns of the declared schema are asked for. Rows that come or go while it is read may be missed."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema, self.conditions = options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (found := condition(f)) is None:
                yield f
            else:
                self.conditions.append(found)

    def _asked(self, more: dict[str, object]) -> str:
        what = {"$filter": " and ".join(self.conditions)} if self.conditions else {}
        return urllib.parse.urlencode(what | more, quote_via=urllib.parse.quote, safe="$,")

    def partitions(self) -> list[InputPartition]:
        with _open(f"{self.options['url']}/$count?{self._asked({})}", _headers(self.options)) as body:
            n = int(body.read().decode("utf-8-sig"))
        rows = int(self.options.get("partition_rows", 10 * int(self.options.get("page_rows", 1000))))
        return [_Range(k * rows, min(rows, n - k * rows)) for k in range(math.ceil(n / rows))] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        order = {"$orderby": self.options["order"]} if "order" in self.options else {}
        got, page = 0, int(self.options.get("page_rows", 1000))
        while got < partition.top:
            ask = {"$select": ",".join(self.schema.names), "$skip": partition.skip + got, "$top": min(page, partition.top - got), "$format": "json"}
            with _open(f"{self.options['url']}?{self._asked(order | ask)}", _headers(self.options)) as body:
                found = json.load(body)
            found = found.get("d", found)
            rows = found.get("results", found.get("value", [])) if isinstance(found, dict) else found
            if not rows:
                return
            for row in rows[: partition.top - got]:
                yield tuple(converted(row.get(f.name), f.dataType) for f in self.schema.fields)
            got += len(rows)  # a service may send fewer than it is asked for


class PagedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def schema(self) -> str:
        raise ValueError("paged_table needs a schema: spark.read.format('paged_table').schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedTableReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Also turns the session's filter pushdown into Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedTable)
