"""Sketches, forests, online trees and streams find rules that are there."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwood.operators.profile import CATEGORIC, NUMERIC
from rillwood.operators.sketch import MixedInsertError, Sketch, SumOutOfRangeError, sketch_by
from rillwood.plans import forest as FO
from rillwood.plans.estimator import KINDS, Clusterer, RillwoodError, learner_for, make_learner
from rillwood.plans.model import Forest
from rillwood.plans.online import OnlineParams, collect_forest, train_online
from rillwood.streaming.streams import Config, Registry

values = st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=150)


@settings(max_examples=40, deadline=None)
@given(values, values, st.integers(2, 20))
def test_sketch_keeps_totals_and_order(a, b, bins):
    x, y = Sketch(bins), Sketch(bins)
    for v in a:
        x.insert(v, v)
    for v in b:
        y.insert(v, v)
    x.merge(y)
    assert math.isclose(x.total, len(a) + len(b)) and len(x.means) <= bins
    assert math.isclose(x.total_sums[0], sum(a) + sum(b), abs_tol=1e-6)
    assert (x.min, x.max) == (min(a + b), max(a + b))
    at = [x.sum(p) for p in sorted([*a, *b, -2e3, 2e3])]
    assert all(p <= q + 1e-9 for p, q in zip(at, at[1:], strict=False)) and at[0] == 0 and math.isclose(at[-1], x.total)
    back = Sketch.from_json(x.to_json())
    assert back.means == x.means and back.sum(0.5) == x.sum(0.5)


def test_sketch_is_near_the_truth():
    rng = random.Random(1)
    xs = sorted(rng.gauss(0, 1) for _ in range(5000))
    s = Sketch(64)
    for x in rng.sample(xs, len(xs)):
        s.insert(x)
    for q in (0.1, 0.5, 0.9):
        assert abs(s.percentiles(q)[q] - xs[int(q * 5000)]) < 0.08
    cuts = s.uniform(16)
    assert 10 <= len(cuts) <= 15 and cuts == sorted(cuts)
    assert abs(s.density(0.0) / 5000 - 0.3989) < 0.06


def test_sketch_refuses():
    s = Sketch().insert(1.0, "a")
    with pytest.raises(MixedInsertError):
        s.insert(2.0, 3.0)
    with pytest.raises(SumOutOfRangeError):
        Sketch().sum(1.0)
    with pytest.raises(MixedInsertError):
        Sketch(categories=["a"]).insert(1.0, "b")
    assert Sketch().insert(None, 4.0).missing == 1 and Sketch().density(1.0) == 0
    assert Sketch(group=["numeric", "categorical"]).insert(1.0, (2.0, "x")).total_sums == [("numeric", [2.0, 4.0, 0.0]), ("categorical", {"x": 1.0})]


def test_sketch_of_groups(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("t"))
    got = {r.g: Sketch.from_json(r.sketch) for r in sketch_by(df, ["g"], "x", "t", 16).collect()}
    assert all(math.isclose(s.total, 1000) and sum(s.total_sums.values()) == 1000 for s in got.values())


def separator(spark, n=2000):
    rng, rows = random.Random(7), []
    for i in range(n):
        good = rng.random() < 0.5
        rows.append((i, float(rng.randint(1, 50) if good else rng.randint(51, 100)), rng.choice("abc") if good else rng.choice("def"), str(good).lower()))
    return spark.createDataFrame(rows, "id long, size double, type string, anomaly string")


@pytest.mark.parametrize("kind", ["rf_classifier", "hoeffding_classifier"])
def test_separator_is_found(spark, kind):
    params = {"trees": 5, "depth": 4} if kind.startswith("rf") else {"split_freq": 50, "delta": 0.05}
    learner = make_learner(kind, **params).fit(separator(spark), "id", ["size"], ["type"], "anomaly")
    assert learner.stats(separator(spark)).first()["accuracy"] > 0.95
    asked = spark.createDataFrame([(1, 99.0, None), (2, 40.0, "a"), (3, None, None)], "id long, size double, type string")
    full = {r.id: r for r in learner.predict(asked, full=True).collect()}
    assert full[3].distribution and sum(full[3].distribution.values()) > 0  # nothing known: the roots answer
    if kind.startswith("rf"):
        assert full[2].prediction == "true"


def test_thresholds_are_found(spark):
    df = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(101)).cast("double").alias("v"), F.lit("c").alias("noise"))
    for at in (10, 50, 90):
        labelled = df.withColumn("y", F.when(F.col("v") <= at, "lo").otherwise("hi"))
        f = FO.ForestTrainer(FO.Params(trees=3, depth=4, mtry=2)).fit(labelled, "id", ["v"], ["noise"], "y")
        assert FO.evaluate(labelled, f).first()["accuracy"] > 0.95


def test_both_ways_of_prediction_agree(spark, monkeypatch):
    df = separator(spark, 600)
    f = FO.ForestTrainer(FO.Params(trees=4, depth=5, mtry=2)).fit(df, "id", ["size"], ["type"], "anomaly")
    f = Forest.from_json(f.to_json())
    asked = df.withColumn("size", F.when(F.col("id") % 5 > 0, F.col("size")))
    compiled = {r.id: r.prediction for r in FO.predict(asked, f).collect()}
    monkeypatch.setattr(FO, "COMPILED_NODES", 0)
    sent = {r.id: (r.prediction, r.distribution) for r in FO.predict(asked, f, full=True).collect()}
    assert {i: p for i, (p, _) in sent.items()} == compiled


def test_regression_and_missing_labels(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, (F.col("id") % 10 > 4).cast("double") * 10).alias("y"))
    for kind in ("rf_regressor", "hoeffding_regressor"):
        params = {"trees": 3, "depth": 3} if kind.startswith("rf") else {"split_freq": 50}
        got = make_learner(kind, **params).fit(df, "id", ["x"], [], "y").stats(df).first()
        assert got["correlation"] > 0.95 and got["total"] == df.filter("y IS NOT NULL").count()


def test_online_state_goes_on(spark):
    df = separator(spark, 1200)
    half = train_online(df.filter("id < 600"), "id", ["size"], ["type"], "anomaly", trees=2, params=OnlineParams(split_freq=40))
    both = train_online(df.filter("id >= 600"), "id", ["size"], ["type"], "anomaly", trees=2, params=OnlineParams(split_freq=40), state=half)
    whole = train_online(df, "id", ["size"], ["type"], "anomaly", trees=2, params=OnlineParams(split_freq=40))
    pick = lambda s: collect_forest(s, "anomaly", ["size"], ["type"]).to_json()
    assert pick(both) == pick(whole)


def test_learners_by_name():
    assert len(KINDS) == 8 and learner_for(CATEGORIC) == "rf_classifier" and learner_for(NUMERIC) == "rf_regressor"
    with pytest.raises(RillwoodError):
        learner_for("TEXT")
    with pytest.raises(RillwoodError):
        make_learner("boosted")


def test_clusters(spark):
    df = spark.createDataFrame([(float(i % 2) * 100, float(i)) for i in range(40)], "x double, y double")
    assert Clusterer(2).fit(df, ["x"]).predict(df).select("prediction").distinct().count() == 2


def test_clusters_of_rows_alike(spark, monkeypatch):
    """k-means holds each distinct row once, a bounded number to a task, and finds the same however the table is cut."""
    from rillwood.plans import estimator

    df = spark.range(3000).select((F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 500 > 0, (F.col("id") % 11).cast("double")).alias("y"))
    one, many = (Clusterer(4).fit(df.repartition(n, "x"), ["x", "y"]) for n in (1, 7))
    assert [list(c) for c in one.model.clusterCenters()] == [list(c) for c in many.model.clusterCenters()]
    assert one.model.summary.predictions.count() == df.dropna().distinct().count()
    assert one.predict(df).count() == df.dropna().count()
    plain = [r.n for r in one.predict(df).groupBy("prediction").agg(F.count("*").alias("n")).collect()]
    assert sum(one.model.summary.predictions.toPandas()["_w"]) == sum(plain)
    monkeypatch.setattr(estimator, "POINTS", 100)
    cut = Clusterer(4).fit(df, ["x", "y"]).model.summary.predictions
    assert max(r.n for r in cut.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 200


def test_stream_learns_and_restarts(spark, tmp_path):
    df = separator(spark, 900)
    df.repartitionByRange(3, "id").write.parquet(str(tmp_path / "in"))
    registry = Registry(spark, Config(str(tmp_path / "streams")))
    s = registry.start_stream({"size": NUMERIC, "type": CATEGORIC, "anomaly": CATEGORIC}, "anomaly", "id", trees=2, stream_id="s1", params=OnlineParams(split_freq=40, delta=0.5))
    s.start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    s.join()
    history = s.stats_history().collect()
    assert len(history) == 3 and history[2]["accuracy"] > 0.85
    again = Registry(spark, Config(str(tmp_path / "streams"))).get_stream("s1")
    assert again.about.version == s.about.version and again.forest().to_json() == s.forest().to_json()
    again.clear_stats()
    assert again.get_stats().first()["n_total"] == 0
    assert registry.streams() == ["s1"] and registry.health()["streams"] == 1
    assert again.get_schema() == {"size": NUMERIC, "type": CATEGORIC, "anomaly": CATEGORIC}
    again.stop()
    assert again.about.status == "CLOSED"


def test_command_line(spark, tmp_path):
    from rillwood.__main__ import main

    (tmp_path / "d.csv").write_text("x,k,y\n" + "".join(f"{i % 20},{'ab'[i % 2]},{'lo' if i % 20 < 10 else 'hi'}\n" for i in range(400)))
    out = main([str(tmp_path / "d.csv"), "y", "--trees", "3", "--depth", "3"], spark)
    assert out["rows"] == 400 and out["stats"]["accuracy"] > 0.95


def test_stream_of_appended_events(spark, tmp_path):
    from rillwood.operators.transforms import drop_where_null
    from rillwood.streaming.streams import StreamError, describe

    config = Config(str(tmp_path / "streams"), reload_seconds=0)
    types, only = {"size": NUMERIC, "anomaly": CATEGORIC}, (drop_where_null(["size"]),)
    s = Registry(spark, config).start_stream(types, "anomaly", "id", trees=1, stream_id="own", transforms=only)
    reader = Registry(spark, config).get_stream("own", only)
    for i in range(4):
        s.append({"id": i, "size": float(i) if i else None, "anomaly": "ab"[i % 2]})
    with pytest.raises(StreamError, match="colour"):
        s.append({"colour": 1})
    s.start()
    s.join()
    assert s.tested().count() == 3  # the transform has left one out
    with pytest.raises(StreamError):
        Registry(spark, config).start_stream(types, "anomaly", "id", stream_id="none").forest()
    assert reader.about.version == -1 and reader.forest().info()["n_models"] == 1
    assert reader.about.version == s.about.version  # looked for when it was asked
    s.train(spark.createDataFrame([(9, 1.0, "a")], "id long, size double, anomaly string"))
    s.append({"id": 10, "size": 2.0, "anomaly": "b"})
    s.start()
    s.join()
    assert s.tested().count() == 5 and s.progress()["error"] is None  # neither way of learning hides the other's batches
    assert '"own"' in describe(s) and s.get_info()["schema"] == types


def test_stream_runs_until_stopped(spark, tmp_path):
    import time

    s = Registry(spark, Config(str(tmp_path / "streams"))).start_stream({"x": NUMERIC, "y": CATEGORIC}, "y", "id", trees=1)
    s.append({"id": 1, "x": 1.0, "y": "a"})
    s.start(seconds=0.2)
    until = time.time() + 60
    while s.about.version < 0 and time.time() < until:
        time.sleep(0.2)
    s.append({"id": 2, "x": 1.0, "y": "a"})
    while s.about.version < 1 and time.time() < until:
        time.sleep(0.2)
    assert s.progress()["active"] and s.progress()["rows"] >= 1
    s.stop()
    assert s.about.version == 1 and not s.progress()["active"] and s.about.status == "CLOSED"


def test_forest_without_labels_predicts_null(spark):
    df = spark.createDataFrame([(1, 1.0)], "id long, x double")
    for trees, classes, kind in (([], None, "double"), ([], [], "string")):
        assert FO.predict(df, Forest(trees, classes, ["x"], [], "y")).dtypes[-1] == ("prediction", kind)
    unlearned = collect_forest(train_online(df.withColumn("y", F.lit(None).cast("string")), "id", ["x"], [], "y", trees=2), "y", ["x"], [])
    assert FO.predict(df, unlearned, full=True).first()[2:] == (None, None)


def test_forest_is_saved_whole(spark, tmp_path):
    from rillwood.plans.estimator import Classifier, Regressor

    df = separator(spark, 400).withColumn("y", F.col("size") * 2)
    c = Classifier(trees=2, depth=3).fit(df, "id", ["size"], ["type"], "anomaly")
    c.model.save(spark, str(tmp_path / "m"))
    assert Forest.load(spark, str(tmp_path / "m")).to_json() == c.model.to_json()
    r = Regressor(trees=2, depth=3).fit(df, "id", ["size"], ["type"], "y")
    assert r.stats(df).first()["mae"] < 10 * c.stats(df).count() * df.agg(F.stddev("y")).first()[0]


def test_sketch_that_is_frozen_or_weighs_gaps():
    frozen, weighed = Sketch(8, freeze=4), Sketch(2, gap_weighted=True)
    for x in (1, 2, 3, 4, 2.2, 100):
        frozen.insert(x)
    assert frozen.means == [1, 2, 3, 4] and frozen.total == 6 and frozen.max == 100
    for x in [0.0] * 50 + [10.0] * 50 + [21.0]:
        weighed.insert(x)
    assert weighed.means[0] == 0.0 and 10 < weighed.means[1] < 11  # the wider gap joins, for it is by a single value
    mean = Sketch(8)
    for x in (1, 2, 3):
        mean.insert(x, 10.0 * x)
    assert mean.average_target(2) is not None


def test_profiles_of_batches(spark, tmp_path):
    from rillwood.streaming.streams import profile_stream

    spark.range(6).selectExpr("cast(id AS double) AS x").repartition(2).write.parquet(str(tmp_path / "in"))
    profile_stream(spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["x"], str(tmp_path / "out")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out/batch=*")).agg(F.sum("n")).first()[0] == 6


def test_forests_join_rows_alike(spark, monkeypatch):
    """A level passes rows alike once a task, and the trees are those of all rows one by one."""
    df = spark.range(6000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("v"), (F.col("id") % 3).cast("string"))).alias("k"), F.when(F.col("id") % 7 > 3, "hi").otherwise("lo").alias("y"), (F.col("id") % 7 * 3).cast("double").alias("z"))
    seen, inner = [], FO.ForestTrainer._histograms

    def counted(self, coded, *more):
        seen.append(coded.count())
        return inner(self, coded, *more)

    monkeypatch.setattr(FO.ForestTrainer, "_histograms", counted)
    for target, regression in (("y", False), ("z", True)):
        for bagging in (True, False):
            trainer = FO.ForestTrainer(FO.Params(trees=3, depth=3, mtry=2, bagging=bagging))
            grown = []
            for cells in (1 << 22, 1):
                monkeypatch.setattr(FO, "CELLS", cells, raising=False)
                seen.clear()
                grown.append(trainer.fit(df.repartition(4, "id"), "id", ["a"], ["k"], target, regression).to_json())
                assert max(seen) <= (4 * 7 * 4 if cells > 1 else 6000)
            assert grown[0] == grown[1] and '"numeric"' in grown[0]
