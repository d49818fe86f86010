"""Hoeffding trees that learn one event at a time, a task a tree.

A tree's own events come in order, so each tree is a sorted stream: events are dealt to the trees with their Poisson weights,
and the trees of a forest grow side by side. Per leaf and attribute a mergeable sketch (numbers) or counts (categories) is kept.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwood.functions.hashing import poisson_weight
from rillwood.operators.sketch import Sketch

from .model import CATEGORIC, LEAF, NUMERIC, Forest, Node


@dataclass(frozen=True)
class OnlineParams:
    split_freq: int = 100
    max_depth: int = 10
    delta: float = 1e-5
    tau: float = 0.05
    bins: int = 64
    splits: int = 16
    integrate_missing: bool = True  # a row with a missing value is judged by the inner node where it stops
    normalize_prediction: bool = False
    seed: int = 42
    extra: bool = False


def uniform_splits(sketch: Sketch, p: OnlineParams, rng: np.random.Generator) -> list[float]:
    """Thresholds of equal mass, or with extra trees one of them at random."""
    found = sketch.uniform(p.splits)
    return [found[int(rng.integers(len(found)))]] if p.extra and found else found


def entropy(counts) -> float:
    c = np.array([x for x in counts if x > 0], float)
    return float(-(c / c.sum() * np.log2(c / c.sum())).sum()) if len(c) else 0.0


def information_gain(sketch: Sketch, split: float) -> float:
    whole = sketch.total_sums or {}
    n, left = sketch.extended_sum(split)
    tau = n / sketch.total
    left = left or {}
    return entropy(whole.values()) - tau * entropy(left.values()) - (1 - tau) * entropy([v - left.get(k, 0.0) for k, v in whole.items()])


def squared_score(sketch: Sketch, split: float) -> float:
    all_, (n, left) = sketch.total_sums, sketch.extended_sum(split)
    rest = sketch.total - n
    if not left or n <= 0 or rest <= 0:
        return 0.0
    return left[0] ** 2 / n + (all_[0] - left[0]) ** 2 / rest


class HoeffdingTree:
    """``candidates`` and ``evaluate`` are what makes splits and what judges them; others may be given."""

    def __init__(self, numeric: list[str], categoric: list[str], regression: bool, params: OnlineParams = OnlineParams(), tree: int = 0, candidates: Callable = uniform_splits, evaluate: Callable | None = None):
        self.numeric, self.categoric, self.regression, self.p, self.tree = numeric, categoric, regression, params, tree
        self.nodes, self.labels = [Node(tree, 0)], []
        self.stats: dict[int, dict[str, Sketch | dict]] = {0: {}}
        self.label_counts: list[dict[str, float]] = [{}]
        self.since = {0: 0.0}
        self.square = [0.0]
        self.rng = np.random.default_rng([params.seed, tree])
        self.candidates, self.evaluate = candidates, evaluate or (squared_score if regression else information_gain)

    def _steps(self, row: dict) -> list[int]:
        path, i = [0], 0
        while self.nodes[i].kind != LEAF:
            n = self.nodes[i]
            x = row.get(n.attr)
            if x is None or (isinstance(x, float) and math.isnan(x)):
                if self.p.integrate_missing:
                    break
                i = n.left
            elif n.kind == CATEGORIC:
                i = n.right if str(x) == n.value else n.left
            else:
                i = n.left if x <= n.split else n.right
            path.append(i)
        return path

    def predict_full(self, row: dict) -> dict[str, float]:
        c = self.label_counts[self._steps(row)[-1]]
        t = sum(c.values())
        return {k: v / t for k, v in c.items()} if self.p.normalize_prediction and t else dict(c)

    def predict(self, row: dict):
        i = self._steps(row)[-1]
        if self.regression:
            return self.nodes[i].total / self.nodes[i].n if self.nodes[i].n else None
        c = self.label_counts[i]
        return min(c, key=lambda k: (-c[k], k)) if c else None

    def update(self, row: dict, y, weight: int = 1) -> None:
        """Learns a labelled row; one without a label teaches nothing."""
        if y is None or weight <= 0 or (self.regression and math.isnan(y)):
            return
        path = self._steps(row)
        for i in path:  # a leaf's labels count for all nodes above it
            self.nodes[i].n += weight
            if self.regression:
                self.nodes[i].total += weight * y
                self.square[i] += weight * y * y
            else:
                self.label_counts[i][str(y)] = self.label_counts[i].get(str(y), 0.0) + weight
        leaf = path[-1]
        if self.nodes[leaf].kind != LEAF or self.nodes[leaf].depth >= self.p.max_depth:
            return
        stats = self.stats[leaf]
        for a in self.numeric:
            x = row.get(a)
            if x is not None and not math.isnan(x):
                stats.setdefault(a, Sketch(self.p.bins)).insert(float(x), float(y) if self.regression else str(y), weight)
        for a in self.categoric:
            x = row.get(a)
            if x is not None:
                by = stats.setdefault(a, {}).setdefault(str(x), [0.0, 0.0, {}])
                by[0] += weight
                if self.regression:
                    by[1] += weight * y
                else:
                    by[2][str(y)] = by[2].get(str(y), 0.0) + weight
        self.since[leaf] += weight
        if self.since[leaf] >= self.p.split_freq:
            self.since[leaf] = 0.0
            self._examine(leaf)

    def _best(self, leaf: int, attr: str) -> tuple[float, object] | None:
        stat, node = self.stats[leaf][attr], self.nodes[leaf]
        base = node.total**2 / node.n if self.regression else 0.0
        if isinstance(stat, Sketch):
            found = [(self.evaluate(stat, s) - base, s) for s in self.candidates(stat, self.p, self.rng) if stat.min <= s < stat.max]
            return max(found, key=lambda g: g[0]) if found else None
        total = sum(b[0] for b in stat.values())
        if len(stat) < 2:
            return None
        if self.regression:
            value, b = max(stat.items(), key=lambda kv: (kv[1][1] ** 2 / kv[1][0], kv[0]))
            rest = sum(x[1] for x in stat.values()) - b[1]
            return b[1] ** 2 / b[0] + (rest**2 / (total - b[0]) if abs(rest) >= 1e-6 else 0.0) - base, value
        whole: dict[str, float] = {}
        for b in stat.values():
            for k, v in b[2].items():
                whole[k] = whole.get(k, 0.0) + v
        value, b = min(stat.items(), key=lambda kv: (kv[1][0] / total * entropy(kv[1][2].values()), kv[0]))
        m = b[0] / total
        return entropy(whole.values()) * (1 - m) - m * entropy(b[2].values()), value

    def _examine(self, leaf: int) -> None:
        node, p = self.nodes[leaf], self.p
        if not self.regression and len(self.label_counts[leaf]) < 2:
            return
        attrs = [a for a in self.numeric + self.categoric if a in self.stats[leaf]]
        most = math.ceil(len(attrs) / 3) if self.regression else math.ceil(math.sqrt(len(attrs)))
        picks = self.rng.permutation(len(attrs))[:most].tolist() if attrs else []
        found = sorted(((b[0], attrs[i], b[1]) for i in sorted(picks) if (b := self._best(leaf, attrs[i]))), key=lambda g: (-g[0], g[1]))
        if not found:
            return
        spread = self.square[leaf] if self.regression else math.log2(1 + len(self.label_counts[0]))
        eps = 0.0 if p.delta == 1.0 else spread * math.sqrt(math.log(1 / p.delta) / (2 * node.n))
        gain, attr, at = found[0]
        if gain <= eps or not (len(found) == 1 or gain - found[1][0] > eps or eps < p.tau):
            return
        node.kind, node.attr, node.gain = (NUMERIC if attr in self.numeric else CATEGORIC), attr, gain
        node.split, node.value = (float(at), None) if node.kind == NUMERIC else (None, str(at))
        node.left, node.right = len(self.nodes), len(self.nodes) + 1
        for child in (node.left, node.right):
            self.nodes.append(Node(self.tree, child, leaf, node.depth + 1))
            self.label_counts.append({})
            self.square.append(0.0)
            self.stats[child], self.since[child] = {}, 0.0
        del self.stats[leaf], self.since[leaf]

    def to_nodes(self, classes: list[str]) -> list[Node]:
        """The tree as plain nodes; a new leaf without labels has those of its parent."""
        for n, c in zip(self.nodes, self.label_counts, strict=True):
            own = c or (self.label_counts[n.parent] if n.parent >= 0 else {})
            n.counts = [own.get(k, 0.0) for k in classes]
        return self.nodes


    def to_json(self) -> str:
        """All that the tree knows; strategies and parameters are given again."""
        stats = {leaf: {a: {"sketch": s.to_json()} if isinstance(s, Sketch) else {"values": s} for a, s in by.items()} for leaf, by in self.stats.items()}
        return json.dumps({"tree": self.tree, "nodes": [asdict(n) for n in self.nodes], "stats": stats, "label_counts": self.label_counts, "since": self.since, "square": self.square, "rng": self.rng.bit_generator.state})

    def restore(self, text: str) -> HoeffdingTree:
        d = json.loads(text)
        self.tree, self.nodes, self.label_counts, self.square = d["tree"], [Node(**n) for n in d["nodes"]], d["label_counts"], d["square"]
        self.stats = {int(leaf): {a: Sketch.from_json(s["sketch"]) if "sketch" in s else s["values"] for a, s in by.items()} for leaf, by in d["stats"].items()}
        self.since = {int(k): v for k, v in d["since"].items()}
        self.rng.bit_generator.state = d["rng"]
        return self


_KEPT = [("model", "string"), ("tested", "long"), ("correct", "long"), ("abs_error", "double")]
_STATE = "tree int, " + ", ".join(f"{c} {k}" for c, k in _KEPT)


def train_online(df: DataFrame, order: str, numeric: list[str], categoric: list[str], target: str, regression: bool = False, trees: int = 10, params: OnlineParams = OnlineParams(), state: DataFrame | None = None) -> DataFrame:
    """(tree, model, tested, correct, abs_error): trees grown over the events of ``df`` in order, from ``state`` if given.

    Each event is first predicted by the tree and then learned as often as its weight says, so ``correct`` is the tree's
    running quality on events it hadn't seen. A tree's events are sorted by the engine, which spills, and stream through one
    task a batch at a time; the task holds the tree alone, which is bounded by its depth.
    """
    y = F.col(target).cast("double" if regression else "string").alias("_y")
    cols = [*[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categoric]]
    held = df.select(F.col(order).cast("long").alias("_order"), y, *cols)
    dealt = held.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).withColumn("_w", poisson_weight(F.col("_order"), F.col("tree"), F.lit(params.seed)))

    names = numeric + categoric
    first = dealt.select("tree", F.lit(1).alias("_turn"), "_order", "_y", "_w", *names, *[F.lit(None).cast(k).alias(c) for c, k in _KEPT])
    rows = first
    if state is not None:  # what is known of a tree comes before its events
        kinds = {f.name: f.dataType for f in dealt.schema.fields}
        known = state.select("tree", F.lit(0).alias("_turn"), F.lit(0).cast("long").alias("_order"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("_y", "_w", *names)], *[c for c, _ in _KEPT])
        rows = first.unionByName(known)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = None, [0, 0, 0.0]

        def out() -> pa.RecordBatch:
            values = [model.tree, model.to_json(), *counts]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["tree", *(c for c, _ in _KEPT)])

        for b in batches:
            tree, turn, _, y, w, *rest = (c.to_pylist() for c in b.columns)
            cells, kept = rest[: len(names)], rest[len(names) :]
            for i in range(b.num_rows):
                if model is None or tree[i] != model.tree:
                    if model is not None:
                        yield out()
                    model, counts = HoeffdingTree(numeric, categoric, regression, params, tree[i]), [0, 0, 0.0]
                if turn[i] == 0:
                    model, counts = HoeffdingTree(numeric, categoric, regression, params, tree[i]).restore(kept[0][i]), [kept[1][i], kept[2][i], kept[3][i]]
                    continue
                if y[i] is None or y[i] != y[i]:
                    continue
                x = {a: (None if c[i] is None or c[i] != c[i] else c[i]) for a, c in zip(names, cells, strict=True)}
                if (p := model.predict(x)) is not None:
                    counts[0] += 1
                    counts[1] += int(not regression and p == y[i])
                    counts[2] += abs(p - y[i]) if regression else 0.0
                model.update(x, y[i], int(w[i]))
        if model is not None:
            yield out()

    ordered = rows.repartition("tree").sortWithinPartitions("tree", "_turn", "_order")
    return ordered.mapInArrow(grow, _STATE)


def collect_forest(state: DataFrame, target: str, numeric: list[str], categoric: list[str], regression: bool = False) -> Forest:
    """The trained trees as a forest: as many nodes as 2 to the depth at most, a tree."""
    models = [HoeffdingTree(numeric, categoric, regression, tree=r["tree"]).restore(r["model"]) for r in state.select("tree", "model").orderBy("tree").collect()]
    classes = sorted({k for m in models for k in m.label_counts[0]})
    trees = [m.to_nodes(classes) for m in models]
    return Forest(trees, None if regression else classes, numeric, categoric, target)
