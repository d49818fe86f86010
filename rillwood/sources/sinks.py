"""Writers: event logs, tables with their schema and metadata, versioned folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_events(events: DataFrame, path: str) -> None:
    """Appends events as gzipped JSON lines."""
    events.write.mode("append").option("compression", "gzip").json(path)


def log_stream(events: DataFrame, path: str, checkpoint: str):
    """A query that appends the stream's events as JSON lines and remembers how far it came."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small object as one JSON line on any file system that Spark writes to."""
    spark.range(1).select(F.lit(json.dumps(value)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_line(spark: SparkSession, value: dict, path: str) -> None:
    """One more object in a folder of JSON lines, as a file of its own."""
    spark.range(1).select(F.lit(json.dumps(value)).alias("value")).coalesce(1).write.mode("append").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_schema(df: DataFrame, path: str, profile: DataFrame | None = None) -> None:
    """The columns with their types and metadata, and beside them the ``profile`` of their values."""
    write_json(df.sparkSession, json.loads(df.schema.json()), f"{path}/schema")
    if profile is not None:
        profile.write.mode("overwrite").parquet(f"{path}/profile")


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(read_json(spark, f"{path}/schema"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/profile")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
