"""Table functions for SQL: entries that a value gives, with columns that follow from the call.

They are called a row at a time from lateral joins. Over a whole table the column expressions of dates.py and text.py do the
same inside the plan.
"""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Parts of a date, by name.
PARTS = {
    "year": lambda t: t.year, "month": lambda t: t.month, "day": lambda t: t.day, "hour": lambda t: t.hour, "minute": lambda t: t.minute, "second": lambda t: t.second,
    "weekday": lambda t: t.isoweekday(), "week": lambda t: t.isocalendar()[1], "yearday": lambda t: t.timetuple().tm_yday, "quarter": lambda t: (t.month + 2) // 3,
}


def _names(what: AnalyzeArgument, known: dict | None = None) -> list[str]:
    if not what.isConstantExpression or not isinstance(what.value, str):
        raise ValueError("the names must be a constant text: they make the columns")
    names = [n.strip() for n in what.value.split(",") if n.strip()]
    if unknown := [n for n in names if known is not None and n not in known]:
        raise ValueError(f"no parts {unknown}; there are {', '.join(known)}")
    return names


class DateEntries:
    """date_entries(ts, 'year,month'): a column for each part named; one row, of nulls for a null date."""

    def __init__(self):
        self.parts: list | None = None

    @staticmethod
    def analyze(ts: AnalyzeArgument, parts: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType()
        for n in _names(parts, PARTS):
            schema = schema.add(n, IntegerType())
        return AnalyzeResult(schema=schema)

    def eval(self, ts: datetime.datetime, parts: str):
        if self.parts is None:
            self.parts = [PARTS[n.strip()] for n in parts.split(",") if n.strip()]
        yield tuple(None if ts is None else p(ts) for p in self.parts)


class Entries:
    """entries('a,b', a, b): a row (name, value, number) for each value that isn't null; ``number`` where it is one."""

    @staticmethod
    def analyze(names: AnalyzeArgument, *values: AnalyzeArgument) -> AnalyzeResult:
        if len(_names(names)) != len(values):
            raise ValueError("a name for each value is needed")
        return AnalyzeResult(schema=StructType().add("name", StringType()).add("value", StringType()).add("number", DoubleType()))

    def eval(self, names: str, *values):
        for name, v in zip(names.split(","), values):
            if v is not None:
                number = isinstance(v, (int, float)) and not isinstance(v, bool)
                yield name.strip(), str(v), float(v) if number else None


def register(spark: SparkSession) -> None:
    spark.udtf.register("date_entries", udtf(DateEntries))
    spark.udtf.register("entries", udtf(Entries))
