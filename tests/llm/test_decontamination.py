"""Benchmark items without an id: their windows are hits of no item."""

import pytest

import corpus_pipeline
from rillwood.llm import decontamination


@pytest.mark.parametrize("block_bytes", [16_000_000, 80])
def test_items_without_an_id_hit(spark, tmp_path, block_bytes):
    docs = spark.createDataFrame([(1, "so a b c d it goes"), (2, "x y z and a b c d"), (3, "none of it")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "A b c d"), ("q", "x y z"), (None, None), (None, "p q r s")], "item_id string, text string")
    found = {r.doc_id: (list(r.hit_spans), list(r.hit_items)) for r in decontamination.find_benchmark(docs, benchmark, block_bytes=block_bytes).collect()}
    assert found == {1: ([1, 5], []), 2: ([0, 3, 4, 8], ["q"]), 3: ([], [])}
    report = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination_report(docs, benchmark).collect()}
    assert report == {1: (4, 0, True), 2: (7, 1, True), 3: (0, 0, False)}
    benchmark.write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [3]


@pytest.mark.parametrize("prefix_bytes", [16_000_000, 300])
def test_large_benchmarks_are_joined(spark, sf_dir, prefix_bytes):
    """Windows that are joined find what windows that are broadcast find, in one pass over prefixes or in many."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "s"), (-2, "", "s"), (None, "Over and over and OVER and over and over, and over", "s"), (-3, "x " * 20_000, "s")], docs.schema))
    extra = spark.createDataFrame([(None, "over and over"), ("rep", "and over and over and over and over and over"), ("rep", "and over and over and over and over and over"), ("none", "--"), ("x", "x x x x x x x x x x x x")], "item_id string, text string")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("CAST(item_id AS STRING) AS item_id", "text").unionByName(extra)
    plain = lambda df: sorted((str(r.doc_id), r.source, r.n_words, tuple(r.hit_spans), tuple(r.hit_items)) for r in df.collect())
    want = decontamination.find_benchmark(docs, bench)
    got = decontamination.find_benchmark(docs, bench, block_bytes=100, prefix_bytes=prefix_bytes)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert plain(got) == plain(want) and sum(bool(r[3]) for r in plain(want)) >= 5
