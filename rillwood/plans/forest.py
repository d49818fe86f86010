"""Forests trained level by level: all trees and all open leaves in one job a level.

Numeric attributes are cut once into at most 64 bins of equal mass, categories are numbered by frequency. Each level every
task adds its rows to histograms of the open leaves (weights of Poisson bagging come from a hash of row and tree), only the
filled cells are shuffled and summed, and windows find the two best splits of each leaf. What the driver sees is one row a
leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwood.functions.hashing import poisson_thresholds
from rillwood.operators import metrics
from rillwood.operators import splits as S
from rillwood.operators.transforms import group_by_parent, top_fields

from .model import CATEGORIC, COMPILED_NODES, LEAF, NUMERIC, Forest, Node, route

#: Values of a category that can be split on, the most frequent ones; rows of others train and go with those that aren't equal.
MAX_VALUES = 255
#: Numbers that a task gathers before it joins rows alike; rows that it adds to histograms at a time.
CELLS, CHUNK = 1 << 22, 1 << 14


@dataclass(frozen=True)
class Params:
    """``delta`` 1 splits on every gain; ``leaf_size`` is the least weight of a leaf that is looked at."""

    trees: int = 30
    depth: int = 10
    delta: float = 1.0
    tau: float = 0.05
    bins: int = 64
    splits: int = 16
    seed: int = 42
    extra: bool = False  # one random threshold instead of the best
    mtry: int | None = None
    leaf_size: float = 2.0
    bagging: bool = True


@dataclass
class Encoding:
    """How attributes become small whole numbers: edges of bins, values by frequency. Null is -1."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categoric: list[str], bins: int) -> Encoding:
        out = cls()
        if numeric:
            shares = [k / bins for k in range(1, bins)]
            num = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
            row = df.agg(*[F.percentile_approx(num(c), shares, 2_000).alias(c) for c in numeric]).first()
            out.edges = {c: sorted(set(row[c] or [])) for c in numeric}
        for c in categoric:
            top = df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(MAX_VALUES)
            out.values[c] = [r["v"] for r in top.collect()]
        return out

    def coded(self, df: DataFrame, trees: int, seed: int, bagging: bool) -> DataFrame:
        """(_y, a code for each attribute, _w0, _w1, ...: the weight in each tree, one for all without bagging) of (_key, _y,
        attributes); values beyond the kept ones share the last code. Of a task's rows those alike in label and codes are one
        with their weights summed, unless most differ: whole weights add up exactly, so no tree can tell."""
        raw = df.select("_key", "_y", *[F.col(f"`{c}`").cast("double").alias(c) for c in self.edges], *[F.col(f"`{c}`").cast("string").alias(c) for c in self.values])
        edges, values = [np.array(e) for e in self.edges.values()], [pa.array(v, pa.string()) for v in self.values.values()]
        like = ["_y", *(f"_a{k}" for k in range(len(edges) + len(values)))]
        weights = [f"_w{t}" for t in range(trees if bagging else 1)]
        names = like + weights

        def codes(b: pa.RecordBatch) -> pa.Table:
            out = []
            for k, e in enumerate(edges):
                x = b.column(2 + k).to_numpy(zero_copy_only=False)  # null is NaN
                out.append(np.where(np.isnan(x), -1, np.searchsorted(e, x)))  # edges below
            for k, v in enumerate(values, 2 + len(edges)):
                at = pc.fill_null(pc.index_in(b.column(k), v), MAX_VALUES).to_numpy(zero_copy_only=False)
                out.append(np.where(pc.is_null(b.column(k)).to_numpy(zero_copy_only=False), -1, at))
            keys = b.column(0).to_numpy()
            out += [bag_weights(keys, t, seed) for t in range(trees)] if bagging else [np.ones(len(keys))]
            return pa.table([b.column(1), *(pa.array(x.astype(np.int32)) for x in out)], names=names)

        def joined(parts: list[pa.Table]) -> pa.Table:
            sums = pa.concat_tables(parts).group_by(like, use_threads=False).aggregate([(w, "sum") for w in weights])
            return pa.table([sums.column(c) for c in like] + [sums.column(f"{w}_sum").cast(pa.int32()) for w in weights], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most, parts, n = max(1, CELLS // len(names)), [], 0
            for b in batches:
                if b.num_rows == 0:
                    continue
                parts.append(codes(b))
                n += b.num_rows
                if n >= most:
                    whole = joined(parts)
                    if whole.num_rows > most // 2:
                        yield from whole.to_batches(max_chunksize=CHUNK)
                        parts, n = [], 0
                    else:
                        parts, n = [whole], whole.num_rows
            if n:
                yield from joined(parts).to_batches(max_chunksize=CHUNK)

        out = raw.mapInArrow(run, ", ".join(["_y double", *(f"{c} int" for c in names[1:])]))
        return out.toDF("_y", *self.edges, *self.values, *weights)


def bag_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights from a hash of key, tree and seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(poisson_thresholds(), (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.float64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at least ``CHUNK`` at a time."""
    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _chosen(attrs: int, most: int, tree: int, node: int, seed: int) -> list[int]:
    rng = np.random.default_rng([seed, tree, node])
    return sorted(rng.permutation(attrs)[:most].tolist())


class ForestTrainer:
    def __init__(self, params: Params = Params()):
        self.p = params

    def fit(self, df: DataFrame, key: str, numeric: list[str], categoric: list[str], target: str, regression: bool = False) -> Forest:
        """A forest for ``target`` from the rows that have one. ``key`` is a whole number that tells rows apart; attributes
        may have nulls. Every value of the target is a label: they are meant to be few, since a cell of a histogram has a
        weight for each."""
        p, attrs = self.p, numeric + categoric
        rows = df.filter(F.col(target).isNotNull())
        enc = Encoding.fit(rows, numeric, categoric, p.bins)
        classes = None
        if not regression:
            classes = sorted(r["t"] for r in rows.select(F.col(target).cast("string").alias("t")).distinct().collect())
            y = F.array_position(F.array(*[F.lit(c) for c in classes]).cast("array<string>"), F.col(target).cast("string")).cast("double") - 1
        else:
            y = F.col(target).cast("double")
        coded = enc.coded(rows.select(F.col(key).cast("long").alias("_key"), y.alias("_y"), *[F.col(f"`{c}`") for c in attrs]).filter("_y IS NOT NULL"), p.trees, p.seed, p.bagging)
        coded.persist()
        try:
            trees = [[Node(t, 0)] for t in range(p.trees)]
            open_ = {(t, 0) for t in range(p.trees)}
            for level in range(1, p.depth + 1):
                if not open_:
                    break
                open_ = self._grow(coded, trees, open_, enc, attrs, numeric, classes, level)
        finally:
            coded.unpersist()
        return Forest(trees, classes, numeric, categoric, target)

    def _grow(self, coded: DataFrame, trees: list[list[Node]], open_: set, enc: Encoding, attrs: list[str], numeric: list[str], classes: list[str] | None, level: int) -> set:
        p, k = self.p, len(classes) if classes else 3
        most = p.mtry or max(1, math.ceil(math.sqrt(len(attrs))) if classes else math.ceil(len(attrs) / 3))
        allowed = {tn: _chosen(len(attrs), most, *tn, p.seed) for tn in open_}
        hist = self._histograms(coded, trees, allowed, attrs, numeric, enc, classes).persist()
        try:
            # attribute -1 has the whole leaf
            wholes = {(r["tree"], r["node"]): r["c"] for r in hist.filter("attr = -1").select("tree", "node", "c").collect()}
            for (t, n), c in wholes.items():
                node = trees[t][n]
                if classes:
                    node.counts, node.n, node.total = list(c), sum(c), 0.0
                else:
                    node.n, node.total = c[0], c[1]
            if level == p.depth:
                return set()
            group, inner = ["tree", "node"], hist.filter("attr >= 0")
            is_cat = F.col("attr") >= len(numeric)
            pure = {tn for tn, c in wholes.items() if (sum(x > 0 for x in c) < 2 if classes else c[0] < p.leaf_size)}
            if classes:
                num, cat = S.gains_numeric(inner.filter(~is_cat), group, k), S.gains_categoric(inner.filter(is_cat), group, k)
            else:
                flat = inner.select(*group, "attr", "bin", F.get("c", F.lit(0)).alias("n"), F.get("c", F.lit(1)).alias("s"), F.get("c", F.lit(2)).alias("q"))
                num, cat = S.scores_numeric(flat.filter(~is_cat), group), S.scores_categoric(flat.filter(is_cat), group)
            if p.extra:
                num = num.withColumn("_h", F.xxhash64(*group, "attr", "split", F.lit(p.seed)))
                num = num.groupBy(*group, "attr").agg(F.min_by(F.struct("split", "gain", "tau"), "_h").alias("b")).select(*group, "attr", "b.*")
            cat = cat.filter((F.col("tau") < 1) & (F.col("split") < MAX_VALUES))  # values beyond the kept ones can't be named
            top = S.top_two(S.best_splits(num.unionByName(cat), group), group).collect()
        finally:
            hist.unpersist()
        fresh: set = set()
        for r in top:
            tn = (r["tree"], r["node"])
            node, c = trees[r["tree"]][r["node"]], wholes[tn]
            if tn in pure or node.n < p.leaf_size:
                continue
            # a numeric target's score is compared with that of the leaf as it is
            base = 0.0 if classes else c[1] * c[1] / c[0]
            gain, second = r["gain"] - base, None if r["second"] is None else r["second"] - base
            spread = S.class_spread(len(classes)) if classes else max(c[2] - base, 1e-12)
            eps = 0.0 if p.delta == 1.0 else spread * math.sqrt(math.log(1 / p.delta) / (2 * node.n))
            if gain <= max(eps, 1e-9) or not (second is None or gain - second > eps or eps < p.tau):
                continue
            tree, attr = trees[r["tree"]], attrs[r["attr"]]
            node.attr, node.gain = attr, float(gain)
            if r["attr"] < len(numeric):
                node.kind, node.split = NUMERIC, float(enc.edges[attr][int(r["split"])])
            else:
                node.kind, node.value = CATEGORIC, enc.values[attr][int(r["split"])]
            node.left, node.right = len(tree), len(tree) + 1
            for child in (node.left, node.right):
                tree.append(Node(node.tree, child, node.node, node.depth + 1))
                fresh.add((node.tree, child))
        return fresh

    def _histograms(self, coded: DataFrame, trees: list[list[Node]], allowed: dict, attrs: list[str], numeric: list[str], enc: Encoding, classes: list[str] | None) -> DataFrame:
        """(tree, node, attr, bin, c) of the open leaves, for the attributes that each may split on and, as attribute -1, in
        whole."""
        p, k = self.p, len(classes) if classes else 3
        coded_trees = []
        for t in trees:  # splits as codes, so rows are routed by what they carry
            code = []
            for n in t:
                code.append(-1 if n.kind == LEAF else enc.edges[n.attr].index(n.split) if n.kind == NUMERIC else enc.values[n.attr].index(n.value))
            coded_trees.append((np.array([attrs.index(n.attr) if n.attr else -1 for n in t]), np.array(code), np.array([n.kind == CATEGORIC for n in t]), np.array([n.left for n in t]), np.array([n.right for n in t])))
        shared = coded.sparkSession.sparkContext.broadcast((coded_trees, allowed))
        width = max([len(e) + 1 for e in enc.edges.values()] + [MAX_VALUES + 1 if enc.values else 1])
        n_attrs = len(attrs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_trees, chosen = shared.value
            cells: dict[tuple[int, int], np.ndarray] = {}
            for b in _gathered(batches):
                y = b.column(0).to_numpy()
                x = np.stack([b.column(1 + a).to_numpy() for a in range(n_attrs)])
                for t, (attr, code, cat, left, right) in enumerate(all_trees):
                    w = b.column(1 + n_attrs + (t if p.bagging else 0)).to_numpy().astype(np.float64)
                    at, moving = np.zeros(len(y), np.int64), np.flatnonzero(w > 0)
                    stuck = w <= 0
                    while len(moving):
                        nd = at[moving]
                        inner = left[nd] >= 0
                        moving, nd = moving[inner], nd[inner]
                        v = x[attr[nd], moving]
                        known = v >= 0
                        stuck[moving[~known]] = True  # a missing value ends the walk in an inner node
                        at[moving] = np.where(known, np.where(np.where(cat[nd], v != code[nd], v <= code[nd]), left[nd], right[nd]), nd)
                        moving = moving[known]
                    rows = np.flatnonzero(~stuck)
                    order = rows[np.argsort(at[rows], kind="stable")]
                    nodes, first = np.unique(at[order], return_index=True)
                    for node, own in zip(nodes.tolist(), np.split(order, first[1:]), strict=True):
                        if (t, node) not in chosen:
                            continue
                        picks = chosen[t, node]
                        h = cells.setdefault((t, node), np.zeros((len(picks) + 1, width, k)))
                        wt, yt = w[own], y[own]
                        if classes:
                            parts = [(yt.astype(np.int64), wt)]
                        else:
                            parts = [(0, wt), (1, wt * yt), (2, wt * yt * yt)]
                        for j, a in enumerate([*picks, None]):
                            v = x[a, own] if a is not None else np.zeros(len(own), np.int64)
                            ok = v >= 0
                            for cls, weight in parts:
                                c = cls[ok] if classes else cls
                                h[j] += np.bincount(v[ok] * k + c, weights=weight[ok], minlength=width * k).reshape(width, k)
            for (t, node), h in cells.items():
                j, bin_ = np.nonzero(np.abs(h).sum(axis=2))
                picks = np.array([*chosen[t, node], -1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), t, np.int32)), pa.array(np.full(len(j), node, np.int32)), pa.array(picks[j].astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(h[j, bin_].tolist(), pa.list_(pa.float64()))], names=["tree", "node", "attr", "bin", "c"])

        parts = coded.mapInArrow(run, "tree int, node int, attr int, bin int, c array<double>")
        return parts.groupBy("tree", "node", "attr", "bin").agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(k)]).alias("c"))


def predict(df: DataFrame, forest: Forest, full: bool = False, vote: bool = False, out_of_bag: tuple[str, int] | None = None) -> DataFrame:
    """``df`` with ``prediction`` and, with ``full``, ``distribution`` (label -> weight).

    A small forest is compiled into the plan, a large one sent to the tasks as arrays. ``out_of_bag`` (key, seed) asks only
    the trees that haven't seen a row. A row without any tree to ask has a null prediction, as has every row where the
    forest has learned no label.
    """
    kind = "double" if forest.classes is None else "string"
    if not forest.trees or forest.classes == []:
        nothing = {"prediction": F.lit(None).cast(kind)} | ({"distribution": F.lit(None).cast("map<string,double>")} if full and kind == "string" else {})
        return df.withColumns(nothing)
    if forest.size <= COMPILED_NODES and not out_of_bag:
        if forest.classes is None:
            return df.withColumn("prediction", forest.mean_expr())
        out = df.withColumn("_c", forest.counts_expr(vote))
        labels = F.array(*[F.lit(c) for c in forest.classes])
        best = F.element_at(labels, F.array_position("_c", F.array_max("_c")).cast("int"))
        out = out.withColumn("prediction", F.when(F.array_max("_c") > 0, best))
        return (out.withColumn("distribution", F.map_from_arrays(labels, "_c")) if full else out).drop("_c")
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays())
    n_num, classes, n = len(forest.numeric), forest.classes, len(df.columns)
    held = df.select("*", *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(forest.numeric)], *[F.col(f"`{c}`").cast("string").alias(f"_x{n_num + i}") for i, c in enumerate(forest.categoric)], (F.col(out_of_bag[0]).cast("long") if out_of_bag else F.lit(0).cast("long")).alias("_key"))
    extra = {"prediction": F.lit(None).cast(kind)} | ({"distribution": F.lit(None).cast("map<string,double>")} if full and classes else {})
    schema = df.withColumns(extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            if b.num_rows == 0:
                continue
            x = [b.column(n + i).to_numpy(zero_copy_only=False) for i in range(n_num)] + [np.array(b.column(i).to_pylist(), dtype=object) for i in range(n + n_num, b.num_columns - 1)]
            keys = b.column(b.num_columns - 1).to_numpy()
            asked, weights, means = np.zeros(b.num_rows), np.zeros((b.num_rows, len(classes or [0]))), np.zeros(b.num_rows)
            for t, tree in enumerate(trees):
                at = route(tree, x) if x else np.zeros(b.num_rows, np.int64)
                use = bag_weights(keys, t, out_of_bag[1]) == 0 if out_of_bag else np.ones(b.num_rows, bool)
                if classes:
                    c = tree["counts"][at]
                    weights += use[:, None] * (np.eye(len(classes))[c.argmax(1)] * (c.sum(1) > 0)[:, None] if vote else c)
                else:
                    ok = use & (tree["n"][at] > 0)
                    means[ok] += tree["total"][at[ok]] / tree["n"][at[ok]]
                    asked += ok
            if classes:
                cols = [pa.array([classes[i] if s > 0 else None for i, s in zip(weights.argmax(1).tolist(), weights.sum(1).tolist(), strict=True)], pa.string())]
                if full:
                    cols.append(pa.array([list(zip(classes, r, strict=True)) for r in weights.tolist()], pa.map_(pa.string(), pa.float64())))
            else:
                cols = [pa.array(np.where(asked > 0, means / np.maximum(asked, 1), np.nan), mask=asked == 0)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], names=schema.names)

    return held.mapInArrow(run, schema)


def importances(nodes: DataFrame, lineage: dict[str, str] | None = None) -> DataFrame:
    """(attribute, importance): gain times rows over all inner nodes, as shares; by parent attribute with a lineage."""
    worth = nodes.filter(F.col("kind") != LEAF).groupBy(F.col("attr").alias("attribute")).agg(F.sum(F.col("gain") * F.col("n")).alias("w"))
    whole = worth.agg(F.sum("w").alias("all_"))
    out = worth.crossJoin(F.broadcast(whole)).select("attribute", F.coalesce(F.try_divide("w", "all_"), F.lit(0.0)).alias("importance"))
    return group_by_parent(out, lineage) if lineage else out


def instance_importances(df: DataFrame, forest: Forest, key: str) -> DataFrame:
    """(key, attribute, importance): the same along each row's own paths."""
    nodes = forest.table(df.sparkSession).select("tree", F.col("node").alias("_node"), "attr", (F.col("gain") * F.col("n")).alias("w"))
    paths = F.array(*[F.struct(F.lit(t).alias("tree"), forest.path_expr(t).alias("path")) for t in range(len(forest.trees))])
    steps = df.select(key, F.explode(paths).alias("p")).select(key, "p.tree", F.explode("p.path").alias("_node"))
    worth = steps.join(F.broadcast(nodes), ["tree", "_node"]).groupBy(key, "attr").agg(F.sum("w").alias("w"))
    return worth.select(key, F.col("attr").alias("attribute"), (F.col("w") / F.sum("w").over(W.partitionBy(key))).alias("importance"))


def leaf_embedding(leaf: Column, a: int = 31, b: int = 7, modulus: int = 263, size: int = 32) -> Column:
    """One-hot of a leaf number at ((a * leaf + b) mod modulus) mod size."""
    at = F.pmod(F.pmod(leaf * a + b, F.lit(modulus)), F.lit(size))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def embed(df: DataFrame, forest: Forest, name: str = "embedding", size: int = 32) -> DataFrame:
    """Sum of the trees' embeddings."""
    out = leaf_embedding(forest.leaf_expr(0), size=size)
    for t in range(1, len(forest.trees)):
        out = F.zip_with(out, leaf_embedding(forest.leaf_expr(t), 31 + 2 * t, size=size), lambda x, y: x + y)
    return df.withColumn(name, out)


def anomaly_score(distribution: Column, actual: Column) -> Column:
    """The share of all labels but the actual one."""
    whole = F.aggregate(F.map_values(distribution), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.coalesce(F.try_divide(F.coalesce(F.try_element_at(distribution, actual), F.lit(0.0)), whole), F.lit(0.0))


def evaluate(df: DataFrame, forest: Forest) -> DataFrame:
    return metrics.prequential_summary(predict(df, forest), forest.target, "prediction", forest.classes is None)


def related_fields(spark, forest: Forest, k: int = -1, lineage: dict[str, str] | None = None) -> DataFrame:
    return top_fields(importances(forest.table(spark), lineage), k)
