"""The pipeline's stages in turn: what each keeps and what it lets go."""

import corpus_pipeline
from rillwood.llm import queries


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[:5] == columns
    n = {k: v.count() for k, v in out.items()}
    assert n["quality"] > n["near_copies"] > n["decontaminate"] > 0
    assert n["decontaminate"] <= n["mix"] == n["shard"]  # no document goes after decontamination
    assert out["decontaminate"].select("doc_id").distinct().count() == out["shard"].select("doc_id").distinct().count()
    sizes = [r["count"] for r in out["shard"].groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    # exact copies that the first stage keeps leave one document
    assert out["near_copies"].groupBy("text").count().filter("count > 1").count() == 0
    again = corpus_pipeline.run(spark, d)
    assert again.columns == out["shard"].columns and again.count() == n["shard"]


def test_every_operator_has_a_query():
    assert {f"op{k}_" for k in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert queries.ORACLE.keys() <= queries.QUERIES.keys()
