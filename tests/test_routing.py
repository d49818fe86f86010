"""Predictions by joins against those of compiled trees."""

import random

import pytest

from rillwood.plans import forest as FO
from rillwood.plans.model import CATEGORIC, NUMERIC, Forest, Node
from rillwood.plans.routing import node_blocks, predict_by_joins

SCHEMA = "id long, a double, b double, c string, d string, n int"


def rows(spark, n=300):
    rng = random.Random(7)
    maybe = lambda v: None if rng.random() < 0.07 else v
    return spark.createDataFrame([(i, maybe(rng.uniform(0, 1)), float("nan") if i % 31 == 0 else maybe(rng.uniform(0, 1)), maybe(rng.choice("xyz")), maybe(rng.choice("pq")), 1) for i in range(n)], SCHEMA)


def random_forest(depth, classes, trees=3, seed=1):
    """Deep and lopsided trees, numbered in an order that isn't that of their levels."""
    rng = random.Random(seed)
    out = []
    for t in range(trees):
        nodes = [Node(t, 0)]
        open_ = [0]
        while open_:
            i = open_.pop(rng.randrange(len(open_)))
            n = nodes[i]
            n.n, n.total, n.counts = 5.0, rng.uniform(0, 9), [float(rng.randrange(9)) for _ in classes or []]
            if n.depth >= depth or (n.depth > 2 and rng.random() < 0.25) or len(nodes) > 120:
                continue
            if rng.random() < 0.7:
                n.kind, n.attr, n.split = NUMERIC, rng.choice("ab"), rng.uniform(0, 1)
            else:
                n.kind, n.attr, n.value = CATEGORIC, *rng.choice([("c", "x"), ("c", "z"), ("d", "p")])
            n.left, n.right = len(nodes), len(nodes) + 1
            nodes += [Node(t, n.left, i, n.depth + 1), Node(t, n.right, i, n.depth + 1)]
            open_ += [n.left, n.right]
        out.append(nodes)
    return Forest(out, classes, ["a", "b"], ["c", "d"])


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("depth", [1, 2, 13])
def test_as_compiled_trees(spark, depth, levels):
    df, f = rows(spark), random_forest(depth, ["u", "v", "w"])
    got = predict_by_joins(df, "id", f.table(spark), f.numeric, f.categoric, f.classes, levels)
    want = FO.predict(df, f, full=True).select("id", "prediction", "distribution")
    plain = lambda t: sorted((r.id, r.prediction, sorted(r.distribution.items())) for r in t.collect())
    assert plain(got) == plain(want)


def test_numbers(spark):
    df, f = rows(spark), random_forest(9, None)
    got = {r.id: r.prediction for r in predict_by_joins(df, "id", f.table(spark), f.numeric, f.categoric, None).collect()}
    assert got == pytest.approx({r.id: r.prediction for r in FO.predict(df, f).collect()})


def test_blocks_hold_every_node_once(spark):
    f = random_forest(13, ["u"], trees=2)
    for levels in (2, 4):
        slots = node_blocks(f.table(spark), f.numeric, f.categoric, levels).selectExpr("explode(slots) AS s").filter("s IS NOT NULL")
        assert slots.count() == f.size


def test_nothing_to_do(spark):
    f = random_forest(3, ["u", "v"])
    assert predict_by_joins(rows(spark).filter("false"), "id", f.table(spark), f.numeric, f.categoric, f.classes).count() == 0
    assert predict_by_joins(rows(spark), "id", f.table(spark).filter("false"), f.numeric, f.categoric, f.classes).count() == 0
