"""Profiles, metrics, splits and transforms on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwood.operators import metrics as M
from rillwood.operators import profile as P
from rillwood.operators import splits as S
from rillwood.operators import transforms as R
from rillwood.operators.ordering import numbered, running_sums


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 100_003).alias("k"))
    got = [(r.k, r.n) for r in numbered(df, "k").collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(k for k, _ in got))]


def test_running_sums_of_nothing(spark):
    assert running_sums(spark.range(0), "id", {"s": F.col("id")}).count() == 0


def test_exponential_averages_follow_the_recursion(spark):
    x = np.random.default_rng(1).random(60)
    got = M.exponential_averages(spark.createDataFrame(list(enumerate(x.tolist())), "i long, x double"), "i", F.col("x")).first()
    for c in M.WEIGHTS:
        s = 0.0
        for n, v in enumerate(x, 1):
            s = c / n * v + (1 - c / n) * s
        assert math.isclose(got[f"exp_avg_{c}"], s, rel_tol=1e-6)
    short = M.exponential_averages(spark.createDataFrame([(0, 1.0)], "k long, x double"), "k", F.col("x")).first()
    assert short["exp_avg_1"] == 1.0 and short["exp_avg_2"] is None


def test_online_auc_is_that_of_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i > 3 and rng.random() < 0.3), float(rng.integers(0, 7))) for i in range(300)] + [(300, None, 1.0), (301, 1, None)]
    last, means, seen = {0: [], 1: []}, {0: 0.5, 1: 0.5}, {0: 0, 1: 0}
    for _, y, s in rows[:300]:
        last[y], seen[y] = [*last[y], s][-10:], seen[y] + 1
        if other := last[1 - y]:
            means[y] += (sum((s > v) + (s == v) / 2 for v in other) / len(other) - means[y]) / seen[y]
    df = spark.createDataFrame(rows, "o long, y int, s double")
    assert math.isclose(M.online_auc(df, "o", F.col("y"), F.col("s")).first()[0], (1 + means[1] - means[0]) / 2, rel_tol=1e-9)
    assert M.online_auc(df.filter("o < 0"), "o", F.col("y"), F.col("s")).first()[0] == 0.5


def test_auc_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), float(rng.integers(8))) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "y int, s double")
    assert math.isclose(M.auc(df, F.col("y"), F.col("s")).first()[0], want, rel_tol=1e-9)
    assert M.auc(df.filter("y = 1"), F.col("y"), F.col("s")).first()[0] is None


def test_confusion_names_what_is_missing(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "b")], "x string, y string")
    assert {tuple(r) for r in M.confusion_matrix(df, "x", "y").collect()} == {("a", "a", 1), ("a", "?", 1), ("?", "b", 1)}
    assert M.accuracy(df, "x", "y").first().asDict() == {"n_correct": 1, "n_total": 2, "accuracy": 0.5}
    assert M.accuracy(df.limit(0), "x", "y").first()["accuracy"] == 0.0


def test_standard_names_of_scores(spark):
    df = spark.createDataFrame([("p", "p")] * 3 + [("p", "n")] + [("n", "p")] * 2, "x string, y string")
    got = {r.label: (r.precision, r.recall) for r in M.class_scores(df, "x", "y").collect()}
    assert got["p"] == (0.6, 0.75)


def test_conflicting_types_raise(spark):
    df = spark.createDataFrame([("a", "1", "NUMERIC"), ("a", "x", "CATEGORIC")], "name string, value string, type string")
    with pytest.raises(Exception, match="types of one attribute differ"):
        P.infer_event_types(df).collect()


def test_profiles_merge(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(-50, 0)], "x double, i int")
    parts = P.numeric_profile(df.filter("i % 2 = 0"), ["x"]).unionByName(P.numeric_profile(df.filter("i % 2 <> 0"), ["x"]))
    a, b = P.merge_profiles(parts).first(), P.numeric_profile(df, ["x"]).first()
    assert (a.n, a.min, a.max) == (b.n, b.min, b.max) == (50, -50.0, -1.0)
    assert math.isclose(a.variance, b.variance) and math.isclose(a["mean"], b["mean"])


def _h(c):
    c = np.array([x for x in c if x > 0], float)
    return float(-(c / c.sum() * np.log2(c / c.sum())).sum()) if len(c) else 0.0


def test_split_gains_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(6)), "ab"[int(rng.integers(2))], float(rng.normal())) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, y string, t double")
    hist = S.class_histogram(df, [], F.lit("x"), F.col("x"), F.col("y"), ["a", "b"])
    count = lambda keep: [sum(keep(x) and y == k for x, y, _ in rows) for k in "ab"]
    whole = count(lambda x: True)
    for r in S.gains_numeric(hist, [], 2).collect():
        left, right = count(lambda x: x <= r.split), count(lambda x: x > r.split)  # noqa: B023
        tau = sum(left) / 300
        assert math.isclose(r.gain, _h(whole) - tau * _h(left) - (1 - tau) * _h(right), abs_tol=1e-9)
    best = S.gains_categoric(hist, [], 2).first()
    costs = {v: sum(count(lambda x: x == v)) / 300 * _h(count(lambda x: x == v)) for v in range(6)}  # noqa: B023
    assert best.split == min(costs, key=costs.get)
    for r in S.scores_numeric(S.value_histogram(df, [], F.lit("x"), F.col("x"), F.col("t")), []).collect():
        left, right = [t for x, _, t in rows if x <= r.split], [t for x, _, t in rows if x > r.split]
        assert math.isclose(r.gain, sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right), rel_tol=1e-9)


def test_related_fields_of_all(spark):
    df = spark.createDataFrame([("a_y", 0.2), ("a_m", 0.3), ("b", 0.5), ("c", 0.0)], "attribute string, importance double")
    grouped = R.group_by_parent(df, {"a_y": "a", "a_m": "a"})
    assert [r.attribute for r in R.top_fields(grouped, -1).collect()] == ["a", "b", "c"]
    assert [r.attribute for r in R.top_fields(grouped, 1).collect()] == ["a"]


def test_derived_columns_know_their_parent(spark):
    df = R.expand_dates("d")(spark.sql("SELECT 1 AS id, timestamp'2024-03-14 01:02:03' AS d"))
    assert R.parents(df)["d_mi"] == "d" and R.parents(df)["id"] == "id"
    r = df.first()
    assert (r.d_y, r.d_m, r.d_d, r.d_dm, r.d_h, r.d_mi, r.d_s) == (2024, 3, "5", 14, 1, 2, 3)


def test_codes_of_equal_order(spark):
    from rillwood.operators.profile import dictionary, merge_dictionaries

    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0), (None, 0), ("a", 0)], "v string, n long")
    first = dictionary(df, "v", "n")
    assert {r["value"]: r["code"] for r in first.collect()} == {"a": 0, "c": 1, "b": 2}
    more = spark.createDataFrame([("z", 0), ("a", 1), ("y", 7)], "value string, code long")
    assert {r["value"]: r["code"] for r in merge_dictionaries(first, more).collect()} == {"a": 0, "c": 1, "b": 2, "z": 3, "y": 4}
    assert dictionary(df.limit(0), "v", "n").count() == 0


def test_small_helpers(spark):
    from rillwood.operators import metrics, transforms

    df = spark.createDataFrame([("a", "a", 1.0, 2.0), ("b", "a", 2.0, 2.0)], "y string, p string, u double, v double")
    assert metrics.error_estimate(df, "y", "p", False).first()[0] == 0.5
    assert abs(metrics.error_estimate(df, "u", "v", True).first()[0] - 0.5**0.5) < 1e-12
    assert {r["actual"]: r["a"] for r in metrics.confusion_wide(df, "y", "p", ["a", "b"]).collect()} == {"a": 1, "b": 1}
    assert df.select(transforms.unmapped(F.array("u", "v"), ["x", "y"]).alias("m")).first()["m"] == {"x": 1.0, "y": 2.0}
    ticks = spark.createDataFrame([(1, None), (None, 5)], "x int, tick int")
    assert transforms.drop_ticks()(ticks).collect() == [(1,)]


def test_distinct_values_are_counted_exactly(spark):
    """1,500 values, more than a sketch tells apart; nulls, both zeros and an attribute without values."""
    from rillwood import queries as Q
    from rillwood.operators import profile as P

    df = spark.range(6000).select((F.col("id") % 1500).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, -0.0).otherwise(0.0)).alias("z"), F.lit(None).cast("int").alias("none"), "id")
    parts = [P.distinct_profile(df.filter(F.col("id") % 3 == k), ["a", "z", "none"]) for k in range(3)]
    got = {r["name"]: (r.n, r.n_distinct) for r in P.exact_distinct(P.merge_distinct(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()}
    assert got == {"a": (6000, 1500), "z": (3000, 1), "none": (0, 0)}
    users = {r["name"]: r.n_distinct for r in Q.QUERIES["profile_distinct"](spark, "/root/testdata/sf0.1").collect()}
    assert users["user_id"] == 1500


def test_native_histogram_of_merged_parts(spark):
    """Thirty partitions of fifty values: the means of the engine's merged parts are rounded and come twice."""
    from rillwood.operators import sketch as K

    df = spark.range(0, 90_000, 1, 30).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).cast("double").alias("x"))
    want = {(r.g, r.x): r["count"] for r in df.groupBy("g", "x").count().collect()}
    assert {(r.g, r["mean"]): r.n for r in K.value_bins(df, ["g"], "x").collect()} == want
    got = K.native_histogram(df, ["g"], "x").collect()
    assert {(r.g, b.x): b.y for r in got for b in r.bins} == want and sum(len(r.bins) for r in got) == len(want)
    many = {r.g: r.bins for r in K.native_histogram(df.withColumn("x", F.col("x") + F.rand(1)), ["g"], "x").collect()}
    assert all(len(b) == 64 for b in many.values()) and sum(x.y for b in many.values() for x in b) == 90_000
