"""Online AUC from histories that merge."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rillwood.operators import metrics
from rillwood.operators.auc import FAIR, RANDOM, StreamingAuc, history, history_auc, merge_histories

Y = lambda: F.col("y") == 1
S = lambda: F.col("s")


def rows(n=2000, seed=3):
    rng = random.Random(seed)
    out = [(i, y := int(rng.random() < 0.3), round(rng.gauss(y, 1), 1)) for i in range(n)]
    return out + [(None, 1, 1.0), (n, None, 1.0), (n + 1, 1, None), (n + 2, 0, float("nan"))]


def kept_by_hand(data, depth, policy):
    md5 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    out = {}
    for o, y, s in data:
        if None in (o, y, s) or s != s:
            continue
        slot, rank = md5(f"slot:{o}") % depth, o if policy == RANDOM else -md5(f"rank:{o}")
        if (y, slot) not in out or rank > out[y, slot][0]:
            out[y, slot] = (rank, o, s)
    return out


@pytest.mark.parametrize("policy", [RANDOM, FAIR])
@pytest.mark.parametrize("depth", [1, 10, 300])
def test_any_partitioning_gives_the_same(spark, policy, depth):
    data = rows()
    want = kept_by_hand(data, depth, policy)
    for parts in (1, 5):
        df = spark.createDataFrame(data, "o long, y int, s double").repartition(parts)
        split = [history(df.filter(F.col("o") % 4 == k), "o", Y(), S(), depth, policy) for k in (3, 0, 2, 1)]
        for got in (history(df, "o", Y(), S(), depth, policy), merge_histories(split[0], merge_histories(*split[1:]))):
            got = got.collect()
            assert {(r.y, r.slot): (r.rank, r.o, r.s) for r in got} == want
            assert sum(r.n for r in got) == 2000


def test_near_the_exact_one(spark):
    df = spark.createDataFrame(rows(4000), "o long, y int, s double")
    exact = metrics.auc(df.filter("NOT isnan(s)"), Y(), S()).first()[0]
    for policy in (RANDOM, FAIR):
        assert history_auc(df, "o", Y(), S(), history(df, "o", Y(), S(), 200, policy)).first()[0] == pytest.approx(exact, abs=0.05)


def test_one_class_or_none(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "o long, y int, s double")
    for d in (df, df.filter("false")):
        assert history_auc(d, "o", Y(), S(), history(d, "o", Y(), S())).first()[0] == 0.5


def test_stream_carries_histories(spark, tmp_path):
    df = spark.createDataFrame(rows(), "o long, y int, s double")
    for k in range(4):
        df.filter(F.floor(F.col("o") / 500) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    one = StreamingAuc(spark, f"{tmp_path}/s", "o", Y(), S(), 50)
    one.start(events).awaitTermination()
    two = StreamingAuc(spark, f"{tmp_path}/s", "o", Y(), S(), 50)
    assert two.batch == 3 and sorted(map(tuple, two.histories().collect())) == sorted(map(tuple, history(df, "o", Y(), S(), 50).collect()))
    sums, seen = {0: [0, 0.0], 1: [0, 0.0]}, []
    for k in range(4):
        now = [r for r in rows() if r[0] is not None and r[0] // 500 == k]
        kept = kept_by_hand(seen, 50, FAIR)
        for o, y, s in now:
            other = [v for (c, _), (_, _, v) in kept.items() if y is not None and c == 1 - y]
            if None not in (o, y, s) and s == s and other:
                sums[y][0] += 1
                sums[y][1] += sum(1.0 if s > v else 0.5 if s == v else 0.0 for v in other) / len(other)
        seen += now
    assert two.auc().first()[0] == pytest.approx((1 + sums[1][1] / sums[1][0] - sums[0][1] / sums[0][0]) / 2)
