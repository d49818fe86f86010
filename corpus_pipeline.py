"""A corpus pipeline in stages; each takes (spark, docs, sf_dir), and the next one reads what it wrote.

quality: documents that the co-trained classifier rejects go. near_copies: of each group of near copies the document with
the smallest id stays. decontaminate: documents with a benchmark passage go. mix: sources are interleaved to target weights,
scarce ones starting over until the longest is through; no document goes. shard: every row gets its shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwood.llm.common import work_dir
from rillwood.llm.decontamination import find_benchmark
from rillwood.llm.mixing import mix
from rillwood.llm.quality import keep_good
from rillwood.llm.sharding import shard
from rillwood.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("hit_spans") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).drop("mix_position", "mix_epoch")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs, ["doc_id", "source", "text"])  # the text settles ties of repeated ids


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mixed), ("shard", sharded)]
#: No SQL trains a classifier or follows fingerprints; tests hold the operators of the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
