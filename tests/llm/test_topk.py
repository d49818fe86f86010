"""Exact top-k search against sorting every score."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwood.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, row int, v string, score string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, 0, 1, "v", "s") for i, e in rows], SCHEMA).repartition(parts)


def brute(rows, k=10):
    """(query_id, rank, vec_id, score) by Python's integers; each row by itself."""
    used = [(n, i, [math.floor(1024 * x) for x in e]) for n, (i, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, i, q in used:
        if i is not None and i % 100 == 0:
            scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j is None, j or 0) for m, j, v in used if m != n]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [1.0, 1e-9, 1e4, 1e12])
def test_every_score(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (size * rng.normal(size=7)).tolist()) for i in range(420)]
    assert found(topk.top_k(table(spark, rows))) == brute(rows)


def test_ties_go_to_small_ids_over_many_tasks(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(i, [0.5, 3.0]) for i in range(300, 420)] + [(i, [1.0, 1.0]) for i in range(420, 425)]
    assert found(topk.top_k(table(spark, rows, 16))) == brute(rows)
    assert found(topk.top_k(table(spark, rows, 16), k=350)) == brute(rows, 350)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(6)
    rows = [(100 * i if i % 10 == 0 else 100 * i + 1, rng.normal(size=3).tolist()) for i in range(70)]
    assert found(topk.top_k(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    """Nulls, non-finite and missing components, other lengths, repeated ids and rows, huge values, extra columns."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, []), (600, [1.0]), (7, [1.0, 2.0, 9.0]), (None, [1.0, 2.0]), (None, [5.0, 5.0]), (8, [1e300, -1e300]), (-100, [-1e18, 3e17])]
    assert found(topk.top_k(table(spark, rows))) == brute(rows)
    assert found(topk.top_k(table(spark, rows[:1], 1))) == []
    assert found(topk.top_k(table(spark, []))) == []
    assert found(topk.top_k(table(spark, [(1, [1.0]), (2, None)]))) == []


def test_other_queries(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") == 3, k=2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(3, 1, 6), (3, 2, 13)]


def test_query_and_sql_agree(spark, sf_dir):
    got = topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert found(got) == sorted(duckdb.sql(topk.TOP_SQL).fetchall(), key=str)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
