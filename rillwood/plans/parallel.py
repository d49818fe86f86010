"""Hoeffding forests grown by all tasks at once.

A micro-batch goes through the trees as they stand. Every task keeps bins of its own rows for each (tree, leaf, attribute) that
may split, the bins of all tasks merge with those of the batches before, and the leaves split from the merged ones, once a
batch, by the Hoeffding test. No row is copied to a tree or moved at all; what is shuffled are bins, and the driver sees a row
a leaf. One tree can take a table of any size. Against trees that look at each event (online.py), a leaf waits for the end of
its batch, so batches should start small; ``grow`` makes them larger and larger.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwood.operators import bins as B
from rillwood.operators import splits as S
from rillwood.sources.sinks import read_json, write_json
from rillwood.sources.work import work_path

from . import strategies
from .forest import bag_weights
from .model import CATEGORIC, LEAF, NUMERIC, Forest, Node, route
from .online import OnlineParams

#: Rows that a task bins at a time; bins of a leaf and attribute that it keeps before it merges them.
CHUNK, HELD = 1 << 16, 16
KEY = "tree int, node int, attr string, "
#: Attributes of rows that are no bins of a leaf: what ended at a node, and how the tree did on rows it hadn't learned.
ENDED, TESTED = "", "?"


def _columns(batch: pa.RecordBatch, numeric: int, categoric: int) -> list[np.ndarray]:
    numbers = [batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(numeric)]
    return numbers + [np.array(batch.column(2 + numeric + i).to_pylist(), dtype=object) for i in range(categoric)]


def _binner(shared, numeric: list[str], categoric: list[str], regression: bool, p: OnlineParams, bagging: bool) -> Callable:
    """Rows (key, y, attributes) to bins of (tree, node, attribute)."""
    attrs = numeric + categoric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, is_open = shared.value
        held: dict[tuple[int, int, str], list[B.Bins]] = {}

        def keep(tree: int, node: int, attr: str, some: B.Bins) -> None:
            parts = held.setdefault((tree, node, attr), [])
            parts.append(some)
            if len(parts) >= HELD:
                parts[:] = [B.merged(parts, p.bins)]

        def learn(rows: pa.RecordBatch) -> None:
            keys, x = rows.column(0).to_numpy(), _columns(rows, len(numeric), len(categoric))
            if regression:
                names, y = B.SUMS, rows.column(1).to_numpy(zero_copy_only=False)
            else:
                names, y = np.unique(np.array(rows.column(1).to_pylist(), dtype=object), return_inverse=True)
                names = names.tolist()
            for t, tree in enumerate(trees):
                w = bag_weights(keys, t, p.seed) if bagging else np.ones(len(keys))
                at = route(tree, x) if x else np.zeros(len(keys), np.int64)
                if tree["known"].any():
                    told = tree["known"][at]
                    if regression:
                        off = np.abs(tree["mean"][at] - y)[told]
                        tested = [told.sum(), 0, off.sum()]
                    else:
                        tested = [told.sum(), (tree["label"][at] == np.array(names, object)[y])[told].sum(), 0]
                    keep(t, -1, TESTED, B.Bins(np.zeros(1), B.SUMS, np.array([tested], np.float64)))
                seen = np.flatnonzero(w > 0)
                for node, some in B.by_leaf(at[seen], np.zeros(len(seen)), w[seen], y[seen], names):
                    keep(t, node, ENDED, some)
                learning = np.flatnonzero((w > 0) & is_open[t][at])
                for i, a in enumerate(attrs):
                    own = learning
                    known = ~np.isnan(x[i][own]) if i < len(numeric) else np.array([v is not None for v in x[i][own]], bool)
                    own = own[known]
                    for node, some in B.by_leaf(at[own], x[i][own], w[own], y[own], names):
                        keep(t, node, a, some)

        waiting, n = [], 0
        for b in batches:
            waiting.append(b)
            n += b.num_rows
            if n >= CHUNK:
                learn(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                waiting, n = [], 0
        if n:
            learn(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
        items = list(held.items())
        for k in range(0, len(items), 1024):
            yield bins_batch([(*key, *B.merged(parts, p.bins).row()) for key, parts in items[k : k + 1024]])

    return run


_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64())]
_BEST = KEY + B.COLUMNS + ", gain double, split double, value string"


def bins_batch(rows: list[tuple], more: list[pa.DataType] = []) -> pa.RecordBatch:
    names = [c.split()[0] for c in _BEST.split(", ")][: 7 + len(more)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS + more)], names=names)


class Judge:
    """Finds the best split of merged bins: ``generate`` makes candidates of numbers, ``evaluate`` judges them, and
    ``evaluate_words`` judges each word against the others."""

    def __init__(self, p: OnlineParams, regression: bool, generate: strategies.Generator | None = None, evaluate: strategies.Evaluator | None = None, evaluate_words: strategies.Evaluator | None = None):
        found = generate or strategies.equal_mass(p.splits)
        self.generate = strategies.one_of(found) if p.extra else found
        self.evaluate = evaluate or (strategies.squared_gain if regression else strategies.information_gain)
        self.evaluate_words = evaluate_words or (strategies.squared_gain if regression else strategies.value_gain)
        self.seed = p.seed

    def best(self, tree: int, node: int, b: B.Bins) -> tuple[float | None, float | None, str | None]:
        """(gain, split, value), the least of equals; nothing where all rows are alike."""
        whole, mass = b.weights.sum(axis=0), b.mass
        if len(b.keys) < 2 or not whole.sum() > 0:
            return None, None, None
        if b.numeric:
            at = self.generate(b.keys, mass, np.random.default_rng([self.seed, tree, node]))
            at = at[at < len(b.keys) - 1]
            if not len(at):
                return None, None, None
            gains = np.round(self.evaluate(np.cumsum(b.weights, axis=0)[at], whole), 12)
            return float(gains.max()), float(b.keys[at[gains.argmax()]]), None
        gains = np.round(self.evaluate_words(b.weights, whole), 12)
        return float(gains.max()), None, str(b.keys[gains.argmax()])


def _merger(judge: Judge, most: int) -> Callable:
    def merge(table: pa.Table) -> pa.Table:
        tree, node, attr = (table.column(c)[0].as_py() for c in ("tree", "node", "attr"))
        b = B.merged(B.read(table), most)
        best = judge.best(tree, node, b) if attr not in (ENDED, TESTED) else (None, None, None)
        return pa.Table.from_batches([bins_batch([(tree, node, attr, *b.row(), *best)], [pa.float64(), pa.float64(), pa.string()])])

    return merge


class ParallelForest:
    """A forest at ``path``: its trees as JSON, the bins of its open leaves as a table, a version a batch."""

    def __init__(self, spark: SparkSession, path: str, numeric: list[str], categoric: list[str], target: str, regression: bool = False, trees: int = 1, params: OnlineParams = OnlineParams(), judge: Judge | None = None):
        self.spark, self.path, self.p = spark, path, params
        self.numeric, self.categoric, self.target, self.regression = numeric, categoric, target, regression
        self.judge = judge or Judge(params, regression)
        self.trees = [[Node(t, 0)] for t in range(trees)]
        self.sums: list[list[dict[str, float]]] = [[{}] for _ in range(trees)]
        self.since = [[0.0] for _ in range(trees)]
        self.tested = [[0.0, 0.0, 0.0] for _ in range(trees)]  # rows, right ones, sum of absolute errors
        self.version, self.closed = -1, []

    # -- written down --------------------------------------------------------------------------------------------------

    _STATE = ("sums", "since", "tested", "version", "closed", "numeric", "categoric", "target", "regression")

    def save(self) -> None:
        state = {k: getattr(self, k) for k in self._STATE} | {"trees": [[asdict(n) for n in t] for t in self.trees], "params": asdict(self.p)}
        write_json(self.spark, state, f"{self.path}/forest/{self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int, judge: Judge | None = None) -> ParallelForest:
        d = read_json(spark, f"{path}/forest/{version}")
        out = cls(spark, path, d["numeric"], d["categoric"], d["target"], d["regression"], len(d["trees"]), OnlineParams(**d["params"]), judge)
        for k in cls._STATE:
            setattr(out, k, d[k])
        out.trees, out.closed = [[Node(**n) for n in t] for t in d["trees"]], [tuple(c) for c in out.closed]
        return out

    # -- learning ------------------------------------------------------------------------------------------------------

    @property
    def tried(self) -> int:
        """How many attributes a leaf may split on each time it is looked at."""
        n = len(self.numeric) + len(self.categoric)
        return math.ceil(n / 3) if self.regression else math.ceil(math.sqrt(n))

    def open_leaf(self, n: Node) -> bool:
        return n.kind == LEAF and n.depth < self.p.max_depth

    def bins(self, batch: DataFrame, key: str) -> DataFrame:
        """The bins of a batch's tasks for the trees as they stand; rows without a target teach nothing."""
        model, is_open = self.forest().arrays(), []
        classes = sorted({k for t in self.sums for s in t for k in s})
        for t, nodes in enumerate(self.trees):
            is_open.append(np.array([self.open_leaf(n) for n in nodes]))
            counts = model[t]["counts"]
            model[t]["known"] = model[t]["n"] > 0 if self.regression else counts.sum(axis=1) > 0
            if self.regression:
                model[t]["mean"] = np.divide(model[t]["total"], model[t]["n"], out=np.zeros(len(nodes)), where=model[t]["n"] > 0)
            else:
                model[t]["label"] = np.array([classes[i] if ok else None for i, ok in zip(counts.argmax(axis=1).tolist(), model[t]["known"].tolist())], object)
        shared = self.spark.sparkContext.broadcast((model, is_open))  # a few numbers a node
        y = F.col(f"`{self.target}`").cast("double" if self.regression else "string")
        held = batch.select(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("_key"), y.alias("_y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in self.numeric], *[F.col(f"`{c}`").cast("string").alias(c) for c in self.categoric])
        held = held.filter("_y IS NOT NULL AND NOT isnan(_y)" if self.regression else "_y IS NOT NULL")
        return held.mapInArrow(_binner(shared, self.numeric, self.categoric, self.regression, self.p, len(self.trees) > 1), KEY + B.COLUMNS)

    def merge(self, parts: DataFrame, fan: int = 0) -> DataFrame:
        """Bins of the same (tree, node, attribute) as one, with the best split. With thousands of tasks, ``fan`` groups are
        merged first."""
        if fan:
            first = parts.withColumn("_part", F.spark_partition_id() % fan).groupBy("tree", "node", "attr", "_part")
            most, kinds = self.p.bins, KEY + B.COLUMNS
            parts = first.applyInArrow(lambda t: pa.Table.from_batches([bins_batch([(*(t.column(c)[0].as_py() for c in ("tree", "node", "attr")), *B.merged(B.read(t), most).row())])]), kinds)
        return parts.groupBy("tree", "node", "attr").applyInArrow(_merger(self.judge, self.p.bins), _BEST)

    def kept(self) -> DataFrame | None:
        """The bins so far of leaves that are still open."""
        if self.version < 0:
            return None
        state = self.spark.read.schema(_BEST).parquet(f"{self.path}/bins/{self.version}").filter(~F.col("attr").isin(ENDED, TESTED)).drop("gain", "split", "value")
        if not self.closed:
            return state
        return state.join(F.broadcast(self.spark.createDataFrame(self.closed, "tree int, node int")), ["tree", "node"], "left_anti")  # what split last time

    def learn(self, batch: DataFrame, key: str, fan: int = 0) -> None:
        """One micro-batch: bins, merged with those before, then splits. The version is complete when its forest is written;
        until then a rerun of the batch starts from the version before and overwrites what there is."""
        parts, state = self.bins(batch, key), self.kept()
        at = f"{self.path}/bins/{self.version + 1}"
        self.merge(parts if state is None else parts.unionByName(state), fan).write.mode("overwrite").parquet(at)
        self.decide(self.spark.read.schema(_BEST).parquet(at))

    def learn_in_steps(self, batch: DataFrame, key: str, first: int = 64, growth: float = 1.5) -> None:
        """One micro-batch in the order of ``key``, cut so that each step has at most ``growth`` - 1 times the rows that the
        trees had learned before it, or ``first``: a leaf waits for the end of a step, so a large first batch would leave
        trees of one split. The rows are written once, a folder a step."""
        n, seen, shares = batch.count(), self._learned(), []
        while n:
            seen += max(first, int((growth - 1) * seen))
            if seen >= self._learned() + n:
                break
            shares.append((seen - self._learned()) / n)
        for part in _in_order(batch, key, shares, f"{self.path}/steps/{self.version + 1}") if shares else [batch]:
            self.learn(part, key)

    def _learned(self) -> int:
        """Rows that the first tree has learned, each as often as its weight says."""
        s = self.sums[0][0]
        return int(s.get("n", 0) if self.regression else sum(s.values()))

    def decide(self, found: DataFrame) -> None:
        """Takes over what ended where and splits the leaves that are due, from merged bins of all attributes."""
        for r in found.filter(F.col("attr").isin(ENDED, TESTED)).select("tree", "node", "names", "weights").collect():  # two rows a node at most
            if r.node < 0:
                self.tested[r.tree] = [x + y for x, y in zip(self.tested[r.tree], r.weights)]
                continue
            self.since[r.tree][r.node] += r.weights[0] if self.regression else sum(r.weights)
            at = r.node
            while at >= 0:  # a leaf's rows count for all nodes above it
                s = self.sums[r.tree][at]
                for k, v in zip(r.names, r.weights):
                    s[k] = s.get(k, 0.0) + v
                at = self.trees[r.tree][at].parent
        self.closed = []
        some = S.random_attributes(found.filter(~F.col("attr").isin(ENDED, TESTED)), ["tree", "node"], "attr", self.tried, self.p.seed + self.version)
        for r in S.top_two(some.filter("gain IS NOT NULL"), ["tree", "node"]).select("tree", "node", "attr", "gain", "split", "value", "second").collect():  # a row a leaf
            if self._splits(r):
                self._split(r)
        self.version += 1
        self.save()

    def _splits(self, r) -> bool:
        node, p, s = self.trees[r.tree][r.node], self.p, self.sums[r.tree][r.node]
        if not self.open_leaf(node) or self.since[r.tree][r.node] < p.split_freq:
            return False
        self.since[r.tree][r.node] = 0.0
        if self.regression:
            n, spread = s["n"], max(s["q"] - s["s"] ** 2 / s["n"], 1e-12)
        else:
            n, spread = sum(s.values()), S.class_spread(len(self.sums[r.tree][0]))
            if sum(v > 0 for v in s.values()) < 2:
                return False
        eps = 0.0 if p.delta == 1.0 else spread * math.sqrt(math.log(1 / p.delta) / (2 * n))
        return r.gain > max(eps, 1e-9) and (r.second is None or r.gain - r.second > eps or eps < p.tau)

    def _split(self, r) -> None:
        nodes = self.trees[r.tree]
        node = nodes[r.node]
        node.kind, node.attr, node.gain, node.split, node.value = (NUMERIC if r.attr in self.numeric else CATEGORIC), r.attr, r.gain, r.split, r.value
        node.left, node.right = len(nodes), len(nodes) + 1
        for child in (node.left, node.right):
            nodes.append(Node(r.tree, child, r.node, node.depth + 1))
            self.sums[r.tree].append({})
            self.since[r.tree].append(0.0)
        self.closed.append((r.tree, r.node))

    # -- asking --------------------------------------------------------------------------------------------------------

    def forest(self) -> Forest:
        """The trees as they stand; a leaf that has no rows yet has those of its parent."""
        classes = sorted({k for t in self.sums for s in t for k in s})
        for nodes, sums in zip(self.trees, self.sums):
            for n, own in zip(nodes, sums):
                own = own or (sums[n.parent] if n.parent >= 0 else {})
                if self.regression:
                    n.n, n.total = own.get("n", 0.0), own.get("s", 0.0)
                else:
                    n.counts = [own.get(k, 0.0) for k in classes]
                    n.n = sum(n.counts)
        return Forest(self.trees, None if self.regression else classes, self.numeric, self.categoric, self.target)

    def quality(self) -> DataFrame:
        """(tree, tested, correct, abs_error) on rows that each tree was asked for before it learned them."""
        return self.spark.createDataFrame([(t, int(n), int(c), float(e)) for t, (n, c, e) in enumerate(self.tested)], "tree int, tested long, correct long, abs_error double")


def grow(df: DataFrame, order: str, numeric: list[str], categoric: list[str], target: str, regression: bool = False, trees: int = 1, params: OnlineParams = OnlineParams(), batches: int = 24, growth: float = 1.5, passes: int = 1, judge: Judge | None = None, path: str | None = None) -> ParallelForest:
    """A forest over ``df`` in the order of ``order``, a number that also tells rows apart for bagging: micro-batches end at
    a growth^(1 - batches) of the rows, at ``growth`` times as many, and so on to all. The columns it needs are written once, a
    folder a batch, so that each row is read once a pass."""
    spark = df.sparkSession
    f = ParallelForest(spark, path or work_path(spark, "forest"), numeric, categoric, target, regression, trees, params, judge)
    held = df.select(F.col(order).cast("long").alias("_order"), F.col(target), *[F.col(f"`{c}`") for c in numeric + categoric if c != target])
    parts = _in_order(held, "_order", [growth**-k for k in range(batches - 1, 0, -1)], f"{f.path}/batches")
    for _ in range(passes):
        for part in parts:
            f.learn(part, "_order")
    return f


def _in_order(df: DataFrame, order: str, shares: list[float], path: str) -> list[DataFrame]:
    """``df``, written to ``path``, cut at these shares of the rows in the order of a whole number, null first."""
    at = F.col(f"`{order}`").cast("long")
    cuts = sorted(set(df.agg(F.percentile_approx(at, shares, 10_000).alias("c")).first()[0] or []))
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.when(at > c, 1).otherwise(0)
    cut = df.withColumn("_batch", batch)
    cut.write.mode("overwrite").partitionBy("_batch").parquet(path)
    whole = df.sparkSession.read.schema(cut.schema).parquet(path)
    return [whole.filter(F.col("_batch") == k) for k in range(len(cuts) + 1)]
