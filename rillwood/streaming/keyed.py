"""Hoeffding forests over a stream whose leaf bins live in the state store.

Each micro-batch of events becomes bins by the trees as they stand (all tasks, no event is shuffled), which are written down
as a folder. A second query reads that folder and keeps the merged bins of each (tree, leaf, attribute) as keyed state in
RocksDB; what it puts out, a row a key, decides the splits. Nothing but the bins of a batch and the keys that they touch is
ever read or written, however large the state is.

Every step can be repeated. A folder of bins that is complete is not made again; the second query goes on from its checkpoint;
a decision that the forest has written down is not taken again. So a stream killed anywhere goes on with the same trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rillwood.operators import bins as B
from rillwood.plans.online import OnlineParams
from rillwood.plans.parallel import _BEST, ENDED, KEY, TESTED, Judge, ParallelForest
from rillwood.sources.sinks import read_json, write_json

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = KEY + B.COLUMNS
_NAMES = [c.split()[0] for c in _BEST.split(", ")]


class LeafBins(StatefulProcessor):
    """The bins of one (tree, leaf, attribute) so far, and with each batch their best split. A row without names says that the
    leaf has split: its state goes."""

    def __init__(self, judge: Judge, most: int):
        self.judge, self.most = judge, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getValueState("bins", "bins string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.bins.update((json.dumps(B.merged(_of(initialState), self.most).row()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tree, node, attr = int(key[0]), int(key[1]), key[2]
        parts, gone = [], False
        for r in rows:
            gone = gone or bool(r["names"].isna().any())
            parts += _of(r[r["names"].notna()])
        if gone:
            self.bins.clear()
            return
        if attr not in (ENDED, TESTED) and self.bins.exists():
            parts.append(B.Bins.of(*json.loads(self.bins.get()[0])))
        b = B.merged(parts, self.most)
        best = (None, None, None)
        if attr not in (ENDED, TESTED):
            self.bins.update((json.dumps(b.row()),))
            best = self.judge.best(tree, node, b)
        yield pd.DataFrame([(tree, node, attr, *b.row(), *best)], columns=_NAMES)

    def close(self) -> None:
        pass


def _of(rows: pd.DataFrame) -> list[B.Bins]:
    listed = lambda v: None if v is None else list(v)
    return [B.Bins.of(listed(r.numbers), listed(r.words), list(r.names), list(r.weights)) for r in rows.itertuples()]


class KeyedStream:
    """A forest at ``path`` that learns a streaming table of events. ``order`` is a whole number that tells events apart.

    ``initial`` starts from a forest that was saved elsewhere: its trees are taken over and the bins of its open leaves become
    the first state.
    """

    def __init__(self, spark: SparkSession, path: str, numeric: list[str], categoric: list[str], target: str, order: str, regression: bool = False, trees: int = 1, params: OnlineParams = OnlineParams(), judge: Judge | None = None, initial: ParallelForest | None = None):
        self.spark, self.path, self.order, self.initial = spark, path, order, initial
        self.batch = -1
        self.forest = ParallelForest(spark, path, numeric, categoric, target, regression, trees, params, judge)
        if self._there(f"{path}/decided"):
            decided = read_json(spark, f"{path}/decided")
            self.batch, self.forest = decided["batch"], ParallelForest.load(spark, path, decided["version"], self.forest.judge)
        elif initial is not None:
            for k in ("trees", "sums", "since", "tested", "version", "closed"):
                setattr(self.forest, k, getattr(initial, k))

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def start(self, events: DataFrame, seconds: float | None = None) -> StreamingQuery:
        """Learns until what is there is done, or every so many ``seconds`` until it is stopped. The session's state store
        becomes RocksDB."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        return events.writeStream.foreachBatch(self.learn).option("checkpointLocation", f"{self.path}/events").trigger(**when).start()

    def learn(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.batch:
            return
        at = f"{self.path}/parts/batch={batch_id}"
        if not self._there(at):
            parts = self.forest.bins(batch, self.order)
            closed = [(t, n, a, None, None, None, None) for t, n in self.forest.closed for a in self.forest.numeric + self.forest.categoric]
            if closed:
                parts = parts.unionByName(self.spark.createDataFrame(closed, _PARTS))
            parts.write.mode("overwrite").parquet(at)
        query = self._merged().writeStream.foreachBatch(self._decide).outputMode("update").option("checkpointLocation", f"{self.path}/keyed").trigger(availableNow=True).start()
        query.awaitTermination()

    def _merged(self) -> DataFrame:
        parts = self.spark.readStream.schema(f"{_PARTS}, batch int").parquet(f"{self.path}/parts")
        first = self.initial.kept() if self.initial is not None else None
        return parts.groupBy("tree", "node", "attr").transformWithStateInPandas(
            LeafBins(self.forest.judge, self.forest.p.bins), outputStructType=_BEST, outputMode="Update", timeMode="None",
            initialState=None if first is None else first.groupBy("tree", "node", "attr"))

    def _decide(self, found: DataFrame, keyed_batch: int) -> None:
        """A batch of the second query is one of the first: each is read to its end before the next is written."""
        if keyed_batch <= self.batch:
            found.write.format("noop").mode("overwrite").save()  # the state of a batch is made by reading it
            return
        found = found.persist()  # three small questions follow
        try:
            self.forest.decide(found)
        finally:
            found.unpersist()
        self.batch = keyed_batch
        write_json(self.spark, {"batch": self.batch, "version": self.forest.version}, f"{self.path}/decided")
