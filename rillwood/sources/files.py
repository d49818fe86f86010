"""Readers of event files: CSV with its dialect, header and types found out, ARFF, JSON lines, parquet tables."""

from __future__ import annotations

import csv
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwood.operators.profile import CATEGORIC, MISSING, NUMERIC, infer_types, missing_to_null, typed

#: Characters that are looked at for the dialect, and rows for the types.
SNIFF, TYPE_ROWS = 2000, 1001


def sniff(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(delimiter, has a header) from the first characters of a file, compressed or not."""
    lines = [r[0] for r in spark.read.text(path).limit(50).collect()]
    head = "\n".join(lines)[:SNIFF]
    try:
        dialect, header = csv.Sniffer().sniff(head, delimiters=",;\t|"), csv.Sniffer().has_header(head)
    except csv.Error:
        return ",", False
    return dialect.delimiter, header


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, missing: list[str] = MISSING, sep: str | None = None, header: bool | None = None, type_rows: int | None = TYPE_ROWS) -> DataFrame:
    """A CSV file (or .gz) as typed columns; without a header they are named 0, 1, 2, ...

    The type of a column is guessed from the first ``type_rows`` rows, or from all for None; later values that break the
    guess are null. Missing tokens are null.
    """
    if sep is None or header is None:
        found = sniff(spark, path)
        sep, header = sep or found[0], found[1] if header is None else header
    raw = spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not header:
        raw = raw.toDF(*map(str, range(len(raw.columns))))
    given = types or {}
    if set(raw.columns) - set(given):
        guessed = infer_types(raw.limit(type_rows) if type_rows else raw, given, missing)
        given = {r["name"]: r["type"] for r in guessed.collect()}
    return typed(raw.select(*[missing_to_null(F.col(f"`{c}`"), missing).alias(c) for c in raw.columns]), given)


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)", re.I)


def read_arff(spark: SparkSession, path: str, missing: list[str] = MISSING) -> DataFrame:
    """An ARFF file (or .gz): names and types from its header; the data is read as CSV in parallel."""
    lines = spark.read.text(path)
    heads = [r[0] for r in lines.filter(F.lower(F.trim("value")).startswith("@attribute")).collect()]
    names, types = [], {}
    for line in heads:
        m = _ATTRIBUTE.match(line.strip())
        name, kind = m[1].strip("'\""), m[2].strip().lower()
        names.append(name)
        types[name] = NUMERIC if kind.split()[0] in ("real", "numeric", "integer") else CATEGORIC
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    text = F.trim("value")
    data = lines.filter((text != "") & ~text.startswith("%") & ~text.startswith("@"))
    row = F.from_csv("value", F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return typed(data.select(row.alias("r")).select("r.*").toDF(*names).select(*[missing_to_null(F.col(f"`{c}`"), missing).alias(c) for c in names]), types)


#: A single event as the service takes it.
EVENT = "timestamp BIGINT, data ARRAY<STRUCT<name: STRING, value: STRING, type: STRING>>"


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events from a folder of JSON lines (or .gz); a line that is none gives a null row, which is left out."""
    reader = spark.readStream.option("maxFilesPerTrigger", 16) if stream else spark.read
    return reader.schema(EVENT).option("mode", "PERMISSIVE").json(path).filter("data IS NOT NULL")


def parse_event_batches(batches: DataFrame, body: str) -> DataFrame:
    """Events from strings that hold a JSON array of them each."""
    return batches.select(F.explode(F.from_json(body, f"ARRAY<STRUCT<{EVENT.replace('timestamp BIGINT', 'timestamp: BIGINT').replace('data ARRAY', 'data: ARRAY')}>>")).alias("e")).select("e.*")


def inflate_batches(df: DataFrame, body: str) -> DataFrame:
    """Adds ``body_text``: zlib-compressed bodies as text, in Arrow batches; null where a body can't be inflated."""
    @F.pandas_udf("string")
    def inflate(bodies: pd.Series) -> pd.Series:
        def one(b):
            try:
                return zlib.decompress(b).decode()
            except (zlib.error, TypeError, UnicodeDecodeError):
                return None

        return bodies.map(one)

    return df.withColumn("body_text", inflate(body))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int = 1) -> DataFrame:
    """A stream of what is added to a folder; files are taken once, in order of their time, hidden ones never."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)
