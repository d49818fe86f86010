"""State that a stream carries from one micro-batch to the next as a table, a version a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillwood.operators import profile as P
from rillwood.sources.sinks import read_json, write_json


class Versioned:
    """Subclasses say what ``state`` is (its columns as DDL) and make the next from the one before and a batch. A version counts
    once ``path``/done names it, so a batch that is done again after a kill gives the same and counts once."""

    columns: str

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        self.batch = read_json(spark, f"{path}/done")["batch"] if there else -1

    def state(self) -> DataFrame:
        """After the last batch; empty before the first."""
        if self.batch < 0:
            return self.spark.createDataFrame([], self.columns)
        return self._version(self.batch)

    def _version(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/state/{batch_id}")

    def fold(self, before: DataFrame, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def written(self, batch: DataFrame, batch_id: int, now: DataFrame) -> None:
        """What else a batch leaves; to be overwritten when it is done again."""

    def learn(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.batch:
            return
        self.fold(self.state(), batch).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{batch_id}")
        self.written(batch, batch_id, self._version(batch_id))
        write_json(self.spark, {"batch": batch_id}, f"{self.path}/done")
        self.batch = batch_id

    def start(self, events: DataFrame, seconds: float | None = None) -> StreamingQuery:
        """Learns until what is there is done, or every so many ``seconds`` until it is stopped."""
        when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        return events.writeStream.foreachBatch(self.learn).option("checkpointLocation", f"{self.path}/progress").trigger(**when).start()


class StreamingProfile(Versioned):
    """The numeric profile of a stream and its distinct counts, over all micro-batches so far; no value is kept."""

    columns = "name string, n long, mean double, variance double, min double, max double, sketch binary"

    def __init__(self, spark: SparkSession, path: str, names: list[str]):
        super().__init__(spark, path)
        self.names = names

    def fold(self, before: DataFrame, batch: DataFrame) -> DataFrame:
        new = P.numeric_profile(batch, self.names).join(P.sketched_profile(batch, self.names).drop("n"), "name")  # a row a name
        both = before.unionByName(new)
        return P.merge_profiles(both).join(P.merge_sketched(both).drop("n"), "name").select(*new.columns)

    def profile(self) -> DataFrame:
        return self.state().join(P.sketched_distinct(self.state()).drop("n"), "name").drop("sketch")
