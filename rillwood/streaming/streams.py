"""Named prediction streams: micro-batches are predicted with the model as it stood, recorded, then learned from.

A stream keeps everything in a folder: its description, a version of its trees for each batch it learned, and a table of
tested events with the epoch of its statistics. Restarting it goes on where its checkpoint ended.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillwood.errors import StreamError
from rillwood.operators import metrics
from rillwood.operators.profile import DATETIME, NUMERIC, numeric_profile
from rillwood.operators.transforms import Transform, pipeline
from rillwood.plans import forest as FO
from rillwood.plans.estimator import learner_for
from rillwood.plans.model import Forest
from rillwood.plans.online import OnlineParams, collect_forest, train_online
from rillwood.plans.parallel import ParallelForest
from rillwood.sources.files import new_files
from rillwood.sources.sinks import append_line, read_json, write_json

WAITING, PROCESSING, CLOSED, ERROR = "WAITING", "PROCESSING", "CLOSED", "ERROR"


@dataclass
class Config:
    """Where streams live, how often a model that another process writes is looked for, and how many files of a stream's own
    events make a batch at most."""

    path: str
    reload_seconds: float = 10
    max_files_per_trigger: int = 16


@dataclass
class Description:
    id: str
    target: str
    order: str
    types: dict[str, str]
    learner: str
    trees: int = 10
    epoch: int = 0
    version: int = -1
    batch: int = -1
    status: str = WAITING
    lineage: dict[str, str] = field(default_factory=dict)
    parallel: bool = False
    grown: int | None = None  # the version of a parallel forest, which has one a step


class Stream:
    """With ``parallel`` in its description all tasks grow its trees, batch by batch (plans/parallel.py); else each tree looks
    at every event, in a task of its own. ``transforms`` make the attributes out of what comes, to be learned as well as asked for; functions aren't written
    down, so whoever loads a stream gives them again."""

    def __init__(self, spark: SparkSession, config: Config, about: Description, params: OnlineParams = OnlineParams(), transforms: tuple[Transform, ...] = ()):
        self.spark, self.config, self.about, self.params = spark, config, about, params
        self.prepared = pipeline(*transforms)
        self.query: StreamingQuery | None = None
        self._looked = time.monotonic()
        self._forest: tuple[int, Forest] | None = None

    # -- files -------------------------------------------------------------------------------------------------------

    @property
    def path(self) -> str:
        return f"{self.config.path}/{self.about.id}"

    def checkpoint(self) -> None:
        """Writes the description; models and tested events are on disk as soon as their batch is done."""
        write_json(self.spark, asdict(self.about), f"{self.path}/stream")

    @classmethod
    def load(cls, spark: SparkSession, config: Config, stream_id: str, transforms: tuple[Transform, ...] = ()) -> Stream:
        return cls(spark, config, Description(**read_json(spark, f"{config.path}/{stream_id}/stream")), transforms=transforms)

    def _model(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/model/{version}")

    def refresh(self) -> bool:
        """Takes over a newer version that another process has written; whether there was one."""
        self._looked = time.monotonic()
        newer = Description(**read_json(self.spark, f"{self.path}/stream"))
        found = newer.version > self.about.version
        if found:
            self.about = newer
        return found

    # -- learning ----------------------------------------------------------------------------------------------------

    @property
    def numeric(self) -> list[str]:
        return [c for c, k in self.about.types.items() if k == NUMERIC and c != self.about.target]

    @property
    def categoric(self) -> list[str]:
        return [c for c, k in self.about.types.items() if k != NUMERIC and c != self.about.target]

    @property
    def regression(self) -> bool:
        return self.about.learner.endswith("regressor")

    def learn(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Predicts a batch with the last model, records how it did, and learns it as the next version. A batch of a query that
        was learned before is left out, so a restart repeats nothing; one without a number is always learned."""
        if batch_id is not None and batch_id <= self.about.batch:
            return
        batch, version = self.prepared(batch), self.about.version + 1
        known = self.about.version >= 0
        if known:
            tested = FO.predict(batch.filter(F.col(self.about.target).isNotNull()), self.forest())
        else:
            tested = batch.filter(F.col(self.about.target).isNotNull()).withColumn("prediction", F.lit(None).cast("double" if self.regression else "string"))
        actual = F.col(self.about.target).cast("double" if self.regression else "string").alias("actual")
        tested.select(F.col(self.about.order).alias("order"), actual, "prediction", F.lit(self.about.epoch).alias("epoch"), F.lit(version).alias("tick")).write.mode("overwrite").parquet(f"{self.path}/tested/tick={version}")
        if self.about.parallel:
            forest = self._parallel(version - 1)
            forest.learn_in_steps(batch, self.about.order)
            self.about.grown = forest.version
            self._learned(version, batch_id)
            return
        state = self._model(self.about.version) if known else None
        grown = train_online(batch, self.about.order, self.numeric, self.categoric, self.about.target, self.regression, self.about.trees, self.params, state)
        grown.write.mode("overwrite").parquet(f"{self.path}/model/{version}")
        self._learned(version, batch_id)

    def _parallel(self, version: int) -> ParallelForest:
        at = f"{self.path}/model"
        if version >= 0:
            return ParallelForest.load(self.spark, at, version if self.about.grown is None else self.about.grown)
        return ParallelForest(self.spark, at, self.numeric, self.categoric, self.about.target, self.regression, self.about.trees, self.params)

    def _learned(self, version: int, batch_id: int | None) -> None:
        self.about.version = version
        self.about.batch = self.about.batch if batch_id is None else batch_id
        self.checkpoint()

    def start(self, events: DataFrame | None = None, seconds: float | None = None) -> StreamingQuery:
        """Learns from a streaming table of wide events, or from those appended to the stream: until what is there is done, or
        every so many ``seconds`` until it is stopped."""
        self.about.status = PROCESSING
        when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        found = self.appended() if events is None else events
        self.query = found.writeStream.foreachBatch(self.learn).option("checkpointLocation", f"{self.path}/progress").trigger(**when).queryName(self.about.id).start()
        return self.query

    def append(self, event: dict) -> None:
        """Keeps one event for the query that learns the stream's own events."""
        if unknown := set(event) - {*self.about.types, self.about.order}:
            raise StreamError(f"no attributes of {self.about.id}: {sorted(unknown)}")
        append_line(self.spark, event, f"{self.path}/events")

    def appended(self) -> DataFrame:
        """The stream of appended events."""
        kinds = {NUMERIC: "DOUBLE", DATETIME: "TIMESTAMP"}
        columns = {self.about.order: "BIGINT"} | {c: kinds.get(k, "STRING") for c, k in self.about.types.items() if c != self.about.order}
        return new_files(self.spark, f"{self.path}/events", ", ".join(f"`{c}` {k}" for c, k in columns.items()), per_trigger=self.config.max_files_per_trigger)

    def train(self, events: DataFrame) -> None:
        """Learns a plain table as one more batch."""
        self.learn(events)

    def join(self, seconds: int | None = None) -> None:
        if self.query:
            self.query.awaitTermination(seconds)
            if (e := self.query.exception()) is not None:
                self.about.status = ERROR
                raise StreamError(str(e))
            self.about.status = WAITING

    def stop(self) -> None:
        if self.query and self.query.isActive:
            self.query.stop()
        self.about.status = CLOSED
        self.checkpoint()

    def progress(self) -> dict:
        """Batches and rows so far, the last error, and whether a query runs."""
        q = self.query
        return {"active": bool(q and q.isActive), "batches": len(q.recentProgress) if q else 0, "rows": sum(p["numInputRows"] for p in q.recentProgress) if q else 0, "error": str(q.exception()) if q and q.exception() else None}

    # -- asking ------------------------------------------------------------------------------------------------------

    def forest(self) -> Forest:
        if not (self.query and self.query.isActive) and time.monotonic() - self._looked >= self.config.reload_seconds:
            self.refresh()  # another process may be the one that learns
        if self.about.version < 0:
            raise StreamError(f"{self.about.id} has learned nothing yet")
        if self._forest is None or self._forest[0] != self.about.version:
            v = self.about.version
            found = self._parallel(v).forest() if self.about.parallel else collect_forest(self._model(v), self.about.target, self.numeric, self.categoric, self.regression)
            self._forest = (v, found)
        return self._forest[1]

    def predict(self, events: DataFrame, full: bool = False) -> DataFrame:
        return FO.predict(self.prepared(events), self.forest(), full and not self.regression)

    def related_fields(self, k: int = -1) -> DataFrame:
        return FO.related_fields(self.spark, self.forest(), k, self.about.lineage)

    def related_fields_instance(self, events: DataFrame, key: str) -> DataFrame:
        return FO.instance_importances(self.prepared(events), self.forest(), key)

    def tested(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Tested events of the current epoch, of the ticks asked for."""
        t = self.spark.read.option("basePath", f"{self.path}/tested").parquet(f"{self.path}/tested").filter(F.col("epoch") >= self.about.epoch)
        t = t if start is None else t.filter(F.col("tick") >= start)
        return t if end is None else t.filter(F.col("tick") <= end)

    def get_stats(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return metrics.prequential_summary(self.tested(start, end), "actual", "prediction", self.regression)

    def stats_history(self) -> DataFrame:
        """A row a tick, in order."""
        t = self.tested()
        if self.regression:
            out = t.groupBy("tick").agg(F.count_if(F.col("prediction").isNotNull()).alias("n"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"))
        else:
            out = t.groupBy("tick").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((F.col("actual") == F.col("prediction")).cast("int"), F.lit(0))).alias("accuracy"))
        return out.orderBy("tick")

    def clear_stats(self) -> None:
        self.about.epoch += 1
        self.checkpoint()

    def get_schema(self, internal: bool = False) -> dict[str, str]:
        """Attribute -> type; derived attributes only when asked for."""
        return {c: k for c, k in self.about.types.items() if internal or self.about.lineage.get(c, c) == c}

    def get_info(self) -> dict:
        return {"stream": asdict(self.about), "schema": self.get_schema(), "learner": self.forest().info() if self.about.version >= 0 else None}


class Registry:
    """All streams of a folder."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.open: dict[str, Stream] = {}

    def start_stream(self, types: dict[str, str], target: str, order: str, learner: str | None = None, trees: int = 10, stream_id: str | None = None, params: OnlineParams = OnlineParams(), transforms: tuple[Transform, ...] = (), parallel: bool = False) -> Stream:
        """A new stream; the learner follows from the target's type unless it is given."""
        about = Description(stream_id or uuid.uuid4().hex, target, order, types, learner or learner_for(types[target]), trees, parallel=parallel)
        s = Stream(self.spark, self.config, about, params, transforms)
        s.checkpoint()
        self.open[about.id] = s
        return s

    def get_stream(self, stream_id: str, transforms: tuple[Transform, ...] = ()) -> Stream:
        if stream_id not in self.open:
            self.open[stream_id] = Stream.load(self.spark, self.config, stream_id, transforms)
        return self.open[stream_id]

    def streams(self) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.config.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(fs_path)) if fs.exists(fs_path) else []

    def stop_stream(self, stream_id: str) -> None:
        self.get_stream(stream_id).stop()
        self.open.pop(stream_id)

    def health(self) -> dict:
        return {"spark": self.spark.version, "streams": len(self.streams()), "active": [q.name for q in self.spark.streams.active]}


def profile_stream(events: DataFrame, columns: list[str], path: str) -> StreamingQuery:
    """A query that writes the numeric profile of each micro-batch; profiles merge into one of all."""

    def write(batch: DataFrame, batch_id: int) -> None:
        numeric_profile(batch, columns).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()


def describe(stream: Stream) -> str:
    return json.dumps(stream.get_info())
