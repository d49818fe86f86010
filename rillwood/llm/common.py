"""What several operators share: the shared work folder, tables cut from lineage, ASCII rules and dense numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session (tests) gets
    a new folder of its machine; on a cluster it is an error, since executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rillwood-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends at replicated files, so a lost
    executor costs no recomputation. The folder's owner removes it with the job's checkpoints."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of ``df`` for, from the sizes of its files; 0 where it doesn't know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else 0


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` doesn't have yet (whatever the case)."""
    have, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in have:
            w = f"_{w}"
        have.add(w.lower())
        out.append(w)
    return out
