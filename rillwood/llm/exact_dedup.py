"""Exact deduplication over a persistent digest index.

The index is a catalog table bucketed and sorted by digest. Adding a batch groups it by digest (one winner each, partial
aggregation first, so a group of any size costs one row a task), drops what the index has with a sort-merge anti-join
that needs no shuffle on the index side, and appends the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, input_bytes, work_dir, write_table

#: Bytes of input for each bucket of a new index, and buckets at least and at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000_000, 64, 100_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of each whole text after lower-casing A-Z only. Null counts as empty."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id) bucketed and sorted by digest; a digest once in the index keeps its row for good. Its files are
    at ``path``, or where the catalog keeps its tables. Each batch adds a file a bucket: sorted in itself, so the merge join
    sorts again from the second batch on, a bucket at a time."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, found: DataFrame) -> None:
        """Appends the digests of ``found`` (id, digest) that the index lacks; of equal ones in the batch the largest id
        stays, a null id only where there is no other."""
        new = found.groupBy("digest").agg(F.max("id").alias("keep_id"))
        if self.exists():
            new = new.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        # a task for each bucket, told by number: the optimizer drops a hash partitioning by digest after the sum's own, and
        # each of its tasks would write a file into nearly every bucket
        writer = new.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)).cast("int")).write.mode("append").format("parquet")
        writer = writer.option("path", self.path) if self.path else writer
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 2, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its digest, the id that stays, the size of its group and whether it stays.

    Batches go to the index from the largest ids to the smallest, so what the index has always outranks what comes. With
    an ``index`` of earlier data its rows stay, ``docs`` equal to them go, and what is new is kept in it for later data; without
    one the index is dropped at the end, and has as many ``buckets`` as the input calls for if they aren't given. Null text equals the empty text; repeated
    ids are rows of their own in ``group_size`` and the first alone (by digest and id) can't be told apart, so all rows
    with the kept id stay; a null id never outranks a number, and a group of null ids alone keeps them. An empty table
    gives an empty result. Other columns of ``docs`` aren't read.
    """
    spark = docs.sparkSession
    found = write_table(digests(docs, id_col, text_col), "digests")
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, input_bytes(docs) // BUCKET_BYTES))
    name = f"digest_index_{uuid.uuid4().hex}"
    own = index or DigestIndex(spark, name, buckets, f"{work_dir(spark)}/{name}")
    try:
        groups = _groups(found, own, batches)
    finally:
        if index is None:
            own.drop()
    return found.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _groups(found: DataFrame, own: DigestIndex, batches: int) -> DataFrame:
    """(digest, group_size, keep_id) of the digests ``found``, added to the index in batches from the largest ids on."""
    low, high = found.agg(F.min("id"), F.max("id")).first()
    if low is None or high - low < batches:
        own.add(found)
    else:
        edges = [low + (high - low + 1) * k // batches for k in range(1, batches)]
        part = sum((F.col("id") >= e).cast("int") for e in edges)
        part = F.coalesce(part, F.lit(0))  # null ids come last, with the smallest
        for k in reversed(range(batches)):
            own.add(found.filter(part == k))
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    # written first, so that the last join has a shuffle alone on either side and a digest of very many rows is split
    return write_table(sizes.join(own.read(), "digest"), "groups")
