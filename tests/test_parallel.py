"""Forests that all tasks grow at once: merged bins, splits against brute force, restarts, and bins in the state store."""

import glob
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwood.operators import bins as B
from rillwood.plans import forest as FO
from rillwood.plans import strategies
from rillwood.plans.online import OnlineParams
from rillwood.plans.parallel import Judge, ParallelForest, grow
from rillwood.streaming.keyed import KeyedStream


def some_bins(rng, n, values, names=("a", "b")):
    x = rng.choice(values, n)
    y = rng.integers(0, len(names), n)
    (_, b), = B.by_leaf(np.zeros(n, int), x.astype(float), np.ones(n), y, list(names))
    return x, y, b


def test_bins_merge_exactly_while_values_are_few():
    rng = np.random.default_rng(1)
    parts = [some_bins(rng, 300, np.arange(40)) for _ in range(5)]
    whole = B.merged([b for *_, b in parts], 64)
    left = B.merged([B.merged([b for *_, b in parts[:2]], 64), B.merged([b for *_, b in reversed(parts[2:])], 64)], 64)
    assert whole.keys.tolist() == left.keys.tolist() and (whole.weights == left.weights).all()
    want = Counter((float(x), int(y)) for xs, ys, _ in parts for x, y in zip(xs, ys))
    assert {(k, c): w for k, r in zip(whole.keys.tolist(), whole.weights) for c, w in enumerate(r) if w} == want


def test_joined_bins_keep_all_weight_and_split_nearly_right():
    rng = np.random.default_rng(2)
    xs, parts = [], []
    for k in range(40):
        x, _, b = some_bins(rng, 2000, rng.normal(k % 3, 1, 5000))
        xs.append(x)
        parts.append(B.merged([b], 64))
        assert len(parts[-1].keys) == 64
    b, x = B.merged(parts, 64), np.sort(np.concatenate(xs))
    assert b.mass.sum() == len(x) and len(b.keys) == 64 and b.keys[-1] == x[-1]
    off = np.abs(np.cumsum(b.mass) - np.searchsorted(x, b.keys, side="right")) / len(x)
    assert off.max() < 0.02


def test_heavy_value_keeps_its_bin():
    rng = np.random.default_rng(3)
    parts = [some_bins(rng, 500, np.append(rng.normal(size=500), np.zeros(1500)))[2] for _ in range(20)]
    b = B.merged(parts, 32)
    assert 0.0 in b.keys.tolist() and b.mass[b.keys == 0.0][0] >= sum(p.mass[p.keys == 0.0].sum() for p in parts)


def rows(n=3000, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size, kind, noise = rng.randrange(40), rng.choice("pqr"), rng.randrange(30)
        out.append((i, None if i % 97 == 0 else float(size), None if i % 89 == 0 else kind, float(noise), "big" if size > 21 and kind != "q" else "small", size * 2.0 + (kind == "q")))
    return out


SCHEMA = "id long, size double, kind string, noise double, label string, worth double"


def plain(f):
    return [(n.tree, n.node, n.kind, n.attr, n.split, n.value, round(n.gain, 9), n.n, n.counts) for t in f.forest().trees for n in t]


def test_partitions_change_nothing(spark):
    found = []
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows(), SCHEMA).repartition(parts)
        found.append(plain(grow(df, "id", ["size", "noise"], ["kind"], "label", trees=3, params=OnlineParams(split_freq=20), batches=6)))
    assert found[0] == found[1] == found[2] and any(n[2] != "leaf" for n in found[0])


def entropy(c):
    n = sum(c.values())
    return -sum(v / n * math.log2(v / n) for v in c.values() if v)


def test_split_is_that_of_all_rows(spark):
    """One batch, every attribute tried, every bin a candidate: the root by brute force."""
    data = rows()
    best = None
    for a, at in (("size", 1), ("noise", 3)):
        known = [(r[at], r[4]) for r in data if r[at] is not None]
        whole = Counter(y for _, y in known)
        for s in sorted({x for x, _ in known})[:-1]:
            left = Counter(y for x, y in known if x <= s)
            right, tau = whole - left, sum(left.values()) / len(known)
            gain = round(entropy(whole) - tau * entropy(left) - (1 - tau) * entropy(right), 12)
            if best is None or gain > best[0]:
                best = (gain, a, s)
    judge = Judge(OnlineParams(), False, generate=strategies.every_bin)
    f = grow(spark.createDataFrame(data, SCHEMA).repartition(5), "id", ["size", "noise"], [], "label", params=OnlineParams(delta=1.0), batches=1, judge=judge)
    root = f.trees[0][0]
    assert (round(root.gain, 9), root.attr, root.split) == (round(best[0], 9), best[1], best[2])
    assert f.forest().trees[0][0].n == len(data) and len(f.trees[0]) == 3


@pytest.mark.parametrize("judge", [(strategies.every_bin, strategies.gini_gain), (strategies.equal_mass(8), strategies.information_gain), (strategies.one_of(strategies.every_bin), strategies.gini_gain)])
def test_other_strategies_level_by_level(spark, judge):
    """Passes over one batch grow a level each, as the level-wise trainer does, with any strategies."""
    df = spark.createDataFrame(rows(), SCHEMA)
    f = grow(df, "id", ["size"], ["kind"], "label", params=OnlineParams(delta=1.0, split_freq=1), batches=1, passes=6, judge=Judge(OnlineParams(), False, judge[0], judge[1], strategies.gini_gain))
    right = FO.predict(df, f.forest()).filter("size IS NOT NULL AND kind IS NOT NULL AND label = prediction").count()
    assert right / df.filter("size IS NOT NULL AND kind IS NOT NULL").count() > 0.95


def test_numbers_are_learned(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    f = grow(df, "id", ["size", "noise"], ["kind"], "worth", regression=True, trees=3, params=OnlineParams(split_freq=20, delta=0.1), batches=8, passes=3)
    off = FO.predict(df.filter("size IS NOT NULL"), f.forest()).agg(F.avg(F.abs(F.col("worth") - F.col("prediction")))).first()[0]
    assert off < 8  # of 80
    assert f.quality().filter("tested > 0 AND abs_error > 0").count() == 3


def test_odd_tables(spark):
    none = grow(spark.createDataFrame([], SCHEMA), "id", ["size"], ["kind"], "label")
    assert FO.predict(spark.createDataFrame(rows(3), SCHEMA), none.forest()).filter("prediction IS NOT NULL").count() == 0
    unlabelled = grow(spark.createDataFrame([(None, None, None, None, None, float("nan"))] * 3, SCHEMA), "id", ["size"], ["kind"], "label")
    assert len(unlabelled.trees[0]) == 1
    same = grow(spark.createDataFrame([(1, 1.0, "p", 1.0, "x", 1.0)] * 400, SCHEMA), "id", ["size"], ["kind"], "label", batches=3)
    assert len(same.trees[0]) == 1 and same.forest().trees[0][0].counts == [400.0]
    assert FO.predict(spark.createDataFrame(rows(3), SCHEMA), same.forest()).filter("prediction = 'x'").count() == 3


def test_many_tasks_merge_in_groups_first(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(16)
    one, two = (ParallelForest(spark, str(tmp_path / x), ["size"], ["kind"], "label", params=OnlineParams(split_freq=20)) for x in "ab")
    one.learn(df, "id")
    two.learn(df, "id", fan=4)
    assert plain(one) == plain(two)


def test_saved_forest_goes_on(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    parts = [df.filter(F.col("id") % 4 == k) for k in range(4)]
    make = lambda at: ParallelForest(spark, str(tmp_path / at), ["size"], ["kind"], "label", trees=2, params=OnlineParams(split_freq=20))
    whole, first = make("whole"), make("cut")
    for p in parts:
        whole.learn(p, "id")
    for p in parts[:2]:
        first.learn(p, "id")
    again = ParallelForest.load(spark, first.path, first.version)
    for p in parts[2:]:
        again.learn(p, "id")
    assert plain(again) == plain(whole) and again.tested == whole.tested


# -- state store -------------------------------------------------------------------------------------------------------


def stream_of(spark, top, files):
    df = spark.createDataFrame(rows(), SCHEMA)
    for k in range(files):
        df.filter(F.col("id") % files == k).coalesce(1).write.mode("append").parquet(f"{top}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")


def batches_of(spark, top):
    """The files in the order in which the stream takes them."""
    import os

    files = sorted((os.stat(f"{top}/in/{x}").st_mtime_ns // 1_000_000, f"{top}/in/{x}") for x in os.listdir(f"{top}/in") if x.endswith(".parquet"))
    return [spark.read.parquet(f) for _, f in files]


@pytest.fixture
def rocks(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_keyed_state_equals_tables(spark, tmp_path, rocks):
    """The stream is killed after the bins are written, and after a decision but before it is committed; it goes on with the
    trees of one that wasn't, and of plain tables."""
    events = stream_of(spark, tmp_path, 4)
    make = lambda: KeyedStream(spark, str(tmp_path / "stream"), ["size"], ["kind"], "label", "id", trees=2, params=OnlineParams(split_freq=20))
    one = make()
    decide, learn = one._decide, one.learn

    def dies_before_deciding(found, batch):
        if batch == 1:
            raise RuntimeError("killed")
        decide(found, batch)

    one._decide = dies_before_deciding
    with pytest.raises(Exception, match="killed"):
        one.start(events).awaitTermination()
    two = make()
    assert two.batch == 0
    done = two._decide

    def dies_after_deciding(found, batch):
        done(found, batch)
        if batch == 2:
            raise RuntimeError("killed")

    two._decide = dies_after_deciding
    with pytest.raises(Exception, match="killed"):
        two.start(events).awaitTermination()
    three = make()
    assert three.batch == 2
    three.start(events).awaitTermination()
    plain_one = ParallelForest(spark, str(tmp_path / "plain"), ["size"], ["kind"], "label", trees=2, params=OnlineParams(split_freq=20))
    for b in batches_of(spark, tmp_path):
        plain_one.learn(b, "id")
    assert three.batch == 3 and plain(three.forest) == plain(plain_one) and any(n[2] != "leaf" for n in plain(plain_one))


def test_keyed_state_starts_from_a_saved_forest(spark, tmp_path, rocks):
    events = stream_of(spark, tmp_path, 3)
    parts = batches_of(spark, tmp_path)
    start, whole = (ParallelForest(spark, str(tmp_path / x), ["size"], ["kind"], "label", params=OnlineParams(split_freq=5000)) for x in "ab")
    start.learn(parts[0], "id")
    for p in [parts[0], *parts]:
        whole.learn(p, "id")
    s = KeyedStream(spark, str(tmp_path / "stream"), ["size"], ["kind"], "label", "id", params=OnlineParams(split_freq=5000), initial=start)
    s.start(events).awaitTermination()
    assert plain(s.forest) == plain(whole)


def test_named_stream_in_parallel(spark, tmp_path):
    """A stream of the registry whose trees all tasks grow; reloaded, it predicts and goes on."""
    from rillwood.operators.profile import CATEGORIC, NUMERIC
    from rillwood.streaming.streams import Config, Registry

    df = spark.createDataFrame(rows(), SCHEMA).select("id", "size", "kind", "label")
    config = Config(str(tmp_path / "streams"), reload_seconds=0)
    s = Registry(spark, config).start_stream({"size": NUMERIC, "kind": CATEGORIC, "label": CATEGORIC}, "label", "id", trees=3, stream_id="p", params=OnlineParams(split_freq=20), parallel=True)
    for k in range(8):
        s.train(df.filter(F.col("id") % 8 == k))
    again = Registry(spark, config).get_stream("p")
    assert plain(again._parallel(again.about.version)) == plain(s._parallel(s.about.version))
    again.train(df)
    known = df.filter("size IS NOT NULL AND kind IS NOT NULL")
    assert again.predict(known).filter("label = prediction").count() / known.count() > 0.95
    assert again.stats_history().count() == 9


def test_large_first_batch_of_a_parallel_stream(spark, tmp_path):
    """A batch is learned in steps, so the next one is predicted by trees of more than one split; a batch that is learned once
    more after a crash gives the same trees."""
    from rillwood.operators.profile import CATEGORIC, NUMERIC
    from rillwood.streaming.streams import Config, Registry, Stream

    df = spark.createDataFrame(rows(), SCHEMA).select("id", "size", "kind", "label")
    config = Config(str(tmp_path / "streams"), reload_seconds=0)
    s = Registry(spark, config).start_stream({"size": NUMERIC, "kind": CATEGORIC, "label": CATEGORIC}, "label", "id", trees=3, stream_id="p", params=OnlineParams(split_freq=20), parallel=True)
    s.train(df.filter("id % 2 = 0"))
    assert max(len(t) for t in s.forest().trees) > 3
    crashed = Stream.load(spark, config, "p")
    crashed._parallel(0).learn_in_steps(df.filter("id % 2 = 1"), "id")  # its description is never written
    s.train(df.filter("id % 2 = 1"))
    history = s.stats_history().collect()
    assert [r.tick for r in history] == [0, 1] and history[1].accuracy > 0.8
    again = Stream.load(spark, config, "p")
    assert plain(again._parallel(1)) == plain(s._parallel(1)) and again.about.grown > 2


@pytest.mark.parametrize("name, table", [("keyed_stream_root", "lineitem"), ("tfidf_stream", "documents")])
def test_micro_batches_stay_with_their_tasks(spark, tmp_path, sf_dir, rocks, name, table):
    """No batch goes through one task, and it still takes three of them to say what all rows say."""
    import duckdb

    from rillwood import queries

    spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(4).write.parquet(str(tmp_path / f"{table}.parquet"))
    landed = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/*/landing/*.parquet"))
    there = landed()
    got = queries.QUERIES[name](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    assert len(landed() - there) > 6
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    names = ", ".join(f'"{c}"' for c in got.columns)
    assert rows == sorted(con.execute(f"SELECT {names} FROM ({queries.ORACLE[name]})").fetchall())
