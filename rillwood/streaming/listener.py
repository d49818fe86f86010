"""What streaming queries did, kept in a folder that outlives them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

_EVENTS = "event string, id string, run string, name string, at double, batch long, rows long, millis long, error string"


class ProgressTable(StreamingQueryListener):
    """Writes each event of every query of the session as a small JSON file under ``path``. Call ``watch``."""

    def __init__(self, spark: SparkSession, path: str):
        self.session, self.path = spark, path

    def watch(self) -> ProgressTable:
        self.session.streams.addListener(self)
        return self

    def leave(self) -> None:
        self.session.streams.removeListener(self)

    def _write(self, **event) -> None:
        """By the file system alone: a Spark job inside a listener would hold the events behind it up."""
        jvm = self.session._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{time.time_ns()}-{uuid.uuid4().hex}.json")
        out = at.getFileSystem(self.session._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(json.dumps(event | {"at": time.time()}).encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        self._write(event="started", id=str(event.id), run=str(event.runId), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(event="progress", id=str(p.id), run=str(p.runId), name=p.name, batch=p.batchId, rows=p.numInputRows, millis=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(event="ended", id=str(event.id), run=str(event.runId), error=event.exception)


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_EVENTS).json(path)


def counters(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, runs, batches, rows, millis, last_error, failed, running): a row a query, over all its runs. A batch that was
    done again after a failure counts once; ``last_error`` is the latest there was, ``failed`` whether the latest run ended
    with it."""
    e = events(spark, path)
    latest = W.partitionBy("id", "batch").orderBy(F.desc("at"))
    done = e.filter("event = 'progress'").withColumn("k", F.row_number().over(latest)).filter("k = 1")
    sums = done.groupBy("id").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sum("millis").alias("millis"))
    runs = e.groupBy("id").agg(
        F.max("name").alias("name"), F.count_distinct(F.when(F.col("event") == "started", F.col("run"))).alias("runs"),
        F.max_by(F.when(F.col("event") == "ended", F.col("error")), F.when(F.col("error").isNotNull(), F.col("at"))).alias("last_error"),
        F.coalesce(F.max_by(F.col("error").isNotNull(), F.when(F.col("event") == "ended", F.col("at"))), F.lit(False)).alias("failed"),
        (F.max_by("event", F.when(F.col("event").isin("started", "ended"), F.col("at"))) == "started").alias("running"))
    zero = F.lit(0).cast("long")
    return runs.join(sums, "id", "left").select("id", "name", "runs", *[F.coalesce(c, zero).alias(c) for c in ("batches", "rows", "millis")], "last_error", "failed", "running")
