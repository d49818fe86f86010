"""Count-min tables and TF-IDF over a stream."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillwood.functions.countmin import CountMin, document_cells, merge_cells
from rillwood.functions.text import term_counts, tfidf_batch
from rillwood.streaming.tfidf import StreamingTfidf


def texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 3, 5, 6])))
    return [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 1, "again again")]


@pytest.mark.parametrize("settings", [CountMin(), CountMin(0.001, 0.99), CountMin(0.2, 0.4)])
def test_never_under_and_seldom_far_over(spark, settings):
    df = spark.createDataFrame(texts(800), "id long, text string").repartition(4)
    terms = term_counts(df, "id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    rows = settings.estimated(terms, F.col("term"), document_cells(df, "text", settings)).collect()
    everything = sum(r.n_docs for r in rows)
    assert all(r.estimate >= r.n_docs for r in rows)
    assert sum(r.estimate > r.n_docs + settings.error * everything for r in rows) <= (1 - settings.confidence) * len(rows)


def test_weights_and_nulls_in_cells(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), (None, 5), ("b", 1)], "x string, n int")
    cells = CountMin(0.001).cells(df, F.col("x"), F.col("n"))
    got = CountMin(0.001).estimated(spark.createDataFrame([("a",), ("b",), ("c",)], "x string"), F.col("x"), cells).collect()
    assert {r.x: r.estimate for r in got} == {"a": 7, "b": 1, "c": 0}
    assert CountMin().estimated(df, F.col("x"), cells.filter("false")).filter("estimate > 0").count() == 0


def test_parts_add_up_whatever_the_order(spark):
    df = spark.createDataFrame(texts(200), "id long, text string")
    parts = [document_cells(df.filter(F.col("id") % 3 == k), "text") for k in range(3)]
    read = lambda t: sorted(map(tuple, t.collect()))
    whole = read(document_cells(df, "text"))
    assert read(merge_cells(*parts)) == whole == read(merge_cells(parts[2], merge_cells(parts[1], parts[0])))
    assert dict((r[0], r[2]) for r in whole if r[0] == -1) == {-1: 203}


def test_stream_goes_on_after_a_kill(spark, tmp_path):
    """Killed after the cells of a batch are written and before its weights: nothing counts twice."""
    df = spark.createDataFrame(texts(300), "id long, text string")
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    settings = CountMin(0.0001, 0.999)
    one = StreamingTfidf(spark, f"{tmp_path}/s", "id", "text", settings)
    cells, learn = one.state, one.learn

    def dies(batch, batch_id):
        if batch_id == 1:
            merge_cells(cells(), document_cells(batch, "text", settings)).write.parquet(f"{tmp_path}/s/state/1")
            raise RuntimeError("killed")
        learn(batch, batch_id)

    one.learn = dies
    with pytest.raises(Exception, match="killed"):
        one.start(events).awaitTermination()
    two = StreamingTfidf(spark, f"{tmp_path}/s", "id", "text", settings)
    assert two.batch == 0
    two.start(events).awaitTermination()
    assert sorted(map(tuple, two.state().collect())) == sorted(map(tuple, document_cells(df, "text", settings).collect()))
    exact = {(r.id, r.term): (r.tf, round(r.weight, 9)) for r in tfidf_batch(df, "id", "text").collect()}
    last = two.weights().filter("batch = 2").collect()
    assert last and all(exact[r.id, r.term] == (r.tf, round(r.weight, 9)) for r in last)
    with_word = Counter(w for _, t in texts(300) for w in set((t or "").split()))
    got = two.estimated(spark.createDataFrame([(w,) for w in with_word], "w string"), "w").collect()
    assert {r.w: r.n_docs for r in got} == dict(with_word)
