"""Trees as data: a table of nodes, a compiler to column expressions, and NumPy routing for large forests."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF, NUMERIC, CATEGORIC = "leaf", "numeric", "categoric"
#: Nodes up to which a forest is compiled into the plan; a larger one is sent to the tasks as arrays.
COMPILED_NODES = 400

NODES = "tree int, node int, parent int, depth int, kind string, attr string, split double, value string, left int, right int, n double, total double, counts array<double>, gain double"


@dataclass
class Node:
    """``x <= split`` goes left, else right; ``x == value`` goes right, else left; a missing x stays here."""

    tree: int
    node: int
    parent: int = -1
    depth: int = 1
    kind: str = LEAF
    attr: str | None = None
    split: float | None = None
    value: str | None = None
    left: int = -1
    right: int = -1
    n: float = 0.0
    total: float = 0.0
    counts: list[float] = field(default_factory=list)
    gain: float = 0.0


@dataclass
class Forest:
    """Nodes of each tree, the node's number being its place; classes in order, or none for a numeric target."""

    trees: list[list[Node]]
    classes: list[str] | None
    numeric: list[str]
    categoric: list[str]
    target: str = ""

    @property
    def size(self) -> int:
        return sum(map(len, self.trees))

    # -- as data -----------------------------------------------------------------------------------------------------

    def table(self, spark: SparkSession) -> DataFrame:
        columns = [c.split() for c in NODES.split(", ")]
        value = lambda n, c, kind: float(n[c]) if kind == "double" and n[c] is not None else n[c]
        return spark.createDataFrame([tuple(value(n, c, k) for c, k in columns) for t in self.trees for n in map(asdict, t)], NODES)

    def to_json(self) -> str:
        return json.dumps({"classes": self.classes, "numeric": self.numeric, "categoric": self.categoric, "target": self.target, "trees": [[asdict(n) for n in t] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        d = json.loads(text)
        return cls([[Node(**n) for n in t] for t in d["trees"]], d["classes"], d["numeric"], d["categoric"], d["target"])

    def save(self, spark: SparkSession, path: str) -> None:
        from rillwood.sources.sinks import write_json

        write_json(spark, json.loads(self.to_json()), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        from rillwood.sources.sinks import read_json

        return cls.from_json(json.dumps(read_json(spark, path)))

    def info(self) -> dict:
        """Size and depth of each tree, and what the forest is for."""
        return {"n_models": len(self.trees), "target": self.target, "classes": self.classes, "trees": [{"size": len(t), "depth": max(n.depth for n in t), "leaves": sum(n.kind == LEAF for n in t)} for t in self.trees]}

    # -- compiled into the plan --------------------------------------------------------------------------------------

    def walk_expr(self, tree: int, value) -> Column:
        """``value(node)`` of the node where a row's walk ends, as one CASE of the size of the tree."""
        nodes = self.trees[tree]

        def walk(i: int) -> Column:
            n = nodes[i]
            if n.kind == LEAF:
                return value(n)
            left, right, x = walk(n.left), walk(n.right), F.col(f"`{n.attr}`")
            missing = x.isNull() if n.kind == CATEGORIC else x.isNull() | F.isnan(x.cast("double"))
            goes_left = x.cast("string") != F.lit(n.value) if n.kind == CATEGORIC else x <= F.lit(n.split)
            return F.when(missing, value(n)).when(goes_left, left).otherwise(right)

        return walk(0)

    def leaf_expr(self, tree: int) -> Column:
        """The number of the node where a row's walk ends."""
        return self.walk_expr(tree, lambda n: F.lit(n.node))

    def path_expr(self, tree: int) -> Column:
        """The inner nodes that a row's walk passes and has a value for, as an array."""
        nodes = self.trees[tree]

        def walk(i: int) -> Column:
            n = nodes[i]
            none = F.array().cast("array<int>")
            if n.kind == LEAF:
                return none
            x = F.col(f"`{n.attr}`")
            here = F.array(F.lit(i))
            goes_left = x.cast("string") != F.lit(n.value) if n.kind == CATEGORIC else x <= F.lit(n.split)
            return F.when(x.isNull(), none).when(goes_left, F.concat(here, walk(n.left))).otherwise(F.concat(here, walk(n.right)))

        return walk(0)

    def counts_expr(self, vote: bool = False, normalise: bool = False) -> Column:
        """Class weights of a row: the counts of its leaves summed over the trees, so larger leaves weigh more; with
        ``vote`` each tree has one vote, with ``normalise`` each leaf's counts sum to 1."""
        arrays = []
        for t in range(len(self.trees)):
            def value(n: Node) -> Column:
                c = np.array(n.counts or [0.0] * len(self.classes))
                if vote:
                    c = np.eye(len(c))[int(c.argmax())] if c.sum() > 0 else c * 0
                elif normalise and c.sum() > 0:
                    c = c / c.sum()
                return F.array(*[F.lit(float(x)) for x in c])

            arrays.append(self.walk_expr(t, value))
        out = arrays[0]
        for a in arrays[1:]:
            out = F.zip_with(out, a, lambda x, y: x + y)
        return out

    def mean_expr(self) -> Column:
        """Mean of the trees' leaf means; trees whose leaf is empty don't count."""
        means = [self.walk_expr(t, lambda n: F.lit(n.total / n.n if n.n else None).cast("double")) for t in range(len(self.trees))]
        held = F.filter(F.array(*means), lambda m: m.isNotNull())
        return F.try_divide(F.aggregate(held, F.lit(0.0), lambda s, m: s + m), F.size(held))

    # -- as arrays ---------------------------------------------------------------------------------------------------

    def arrays(self) -> list[dict[str, np.ndarray]]:
        column = {c: i for i, c in enumerate(self.numeric + self.categoric)}
        out = []
        for t in self.trees:
            out.append({
                "attr": np.array([column.get(n.attr, -1) for n in t]), "cat": np.array([n.kind == CATEGORIC for n in t]),
                "split": np.array([n.split if n.split is not None else np.nan for n in t]), "value": np.array([n.value for n in t], dtype=object),
                "left": np.array([n.left for n in t]), "right": np.array([n.right for n in t]),
                "counts": np.array([n.counts or [0.0] * len(self.classes or [0]) for n in t], float), "n": np.array([n.n for n in t]), "total": np.array([n.total for n in t]),
            })
        return out


def route(tree: dict[str, np.ndarray], x: list[np.ndarray]) -> np.ndarray:
    """Where each row's walk ends; x: a column for each attribute, numbers with NaN or strings with None."""
    at = np.zeros(len(x[0]) if x else 0, np.int64)
    moving = np.arange(len(at))
    while len(moving):
        node = at[moving]
        inner = tree["left"][node] >= 0
        moving, node = moving[inner], node[inner]
        go = []
        for a in np.unique(tree["attr"][node]):
            own = tree["attr"][node] == a
            rows, nd, col = moving[own], node[own], x[a][moving[own]]
            if tree["cat"][nd[0]]:
                known, left = np.array([v is not None for v in col], bool), col != tree["value"][nd]
            else:
                known = ~np.isnan(col)
                left = col <= tree["split"][nd]
            at[rows[known]] = np.where(left, tree["left"][nd], tree["right"][nd])[known]
            go.append(rows[known])
        moving = np.sort(np.concatenate(go)) if go else moving[:0]
    return at
