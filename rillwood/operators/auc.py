"""The online AUC from bounded histories of scores that merge.

A history has ``depth`` slots a class. Each row belongs to the slot that the md5 of its order gives it, and a slot keeps one row:
the latest (RANDOM: a newcomer takes a random place, so what stays has a geometric age) or the one with the least hash (FAIR:
every row so far is as likely to be there). Both are a maximum by slot, so histories of partitions, batches and streams merge
by taking maxima, in any order, to the history of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwood.functions.hashing import md5_int
from rillwood.streaming.versions import Versioned

RANDOM, FAIR = "random", "fair"
_HISTORY = "y int, slot int, rank long, o long, s double, n long"


def _scored(df: DataFrame, order: str, positive: Column, score: Column) -> DataFrame:
    """(o, y, s) of the rows that have all three."""
    d = df.select(F.col(order).cast("long").alias("o"), positive.cast("int").alias("y"), score.cast("double").alias("s"))
    return d.filter("o IS NOT NULL AND y IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")


def history(df: DataFrame, order: str, positive: Column, score: Column, depth: int = 10, policy: str = FAIR) -> DataFrame:
    """(y, slot, rank, o, s, n): the row that each slot of each class keeps, and how many came to it. ``order`` is a whole
    number, its own for each row."""
    if policy not in (RANDOM, FAIR):
        raise ValueError(f"no policy {policy!r}")
    d = _scored(df, order, positive, score)
    slot = F.pmod(md5_int(F.concat(F.lit("slot:"), F.col("o").cast("string"))), F.lit(depth)).cast("int")
    rank = F.col("o") if policy == RANDOM else -md5_int(F.concat(F.lit("rank:"), F.col("o").cast("string")))
    return _kept(d.select("y", slot.alias("slot"), rank.alias("rank"), "o", "s", F.lit(1).cast("long").alias("n")))


def _kept(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("y", "slot").agg(F.max(F.struct("rank", "o", "s")).alias("b"), F.sum("n").alias("n"))
    return best.select("y", "slot", "b.rank", "b.o", "b.s", "n")


def merge_histories(*parts: DataFrame) -> DataFrame:
    """Histories of the same depth and policy as one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return _kept(whole)


def beaten(df: DataFrame, order: str, positive: Column, score: Column, kept: DataFrame) -> DataFrame:
    """(y, c, m): how many rows of each class met a history of the other, and the sum of the shares they beat, ties half. The
    history comes along as two arrays of at most ``depth`` scores."""
    sides = kept.agg(*[F.sort_array(F.collect_list(F.when(F.col("y") == y, F.col("s")))).alias(f"h{y}") for y in (0, 1)])  # one row
    d = _scored(df, order, positive, score).crossJoin(F.broadcast(sides))
    other = F.when(F.col("y") == 1, F.col("h0")).otherwise(F.col("h1"))
    won = F.aggregate(other, F.lit(0.0), lambda t, v: t + F.when(F.col("s") > v, 1.0).when(F.col("s") == v, 0.5).otherwise(0.0))
    return d.filter(F.size(other) > 0).groupBy("y").agg(F.count(F.lit(1)).alias("c"), F.sum(won / F.size(other)).alias("m"))


def estimate(sums: DataFrame) -> DataFrame:
    """One row: (1 + mean of class 1 - mean of class 0) / 2, a class without rows counting as a half."""
    mean = lambda y: F.coalesce(F.try_divide(F.sum(F.when(F.col("y") == y, F.col("m"))), F.sum(F.when(F.col("y") == y, F.col("c")))), F.lit(0.5))
    return sums.agg(((1 + mean(1) - mean(0)) / 2).alias("auc"))


def history_auc(df: DataFrame, order: str, positive: Column, score: Column, kept: DataFrame) -> DataFrame:
    """One row: the AUC of ``df`` against histories that may come from elsewhere."""
    return estimate(beaten(df, order, positive, score, kept))


class StreamingAuc(Versioned):
    """A running AUC: the rows of each micro-batch meet the histories of the batches before, and are then added to them."""

    columns = _HISTORY + ", c long, m double"

    def __init__(self, spark: SparkSession, path: str, order: str, positive: Column, score: Column, depth: int = 10, policy: str = FAIR):
        super().__init__(spark, path)
        self.of, self.depth, self.policy = (order, positive, score), depth, policy

    def histories(self, state: DataFrame | None = None) -> DataFrame:
        return (self.state() if state is None else state).filter("slot IS NOT NULL").drop("c", "m")

    def fold(self, before: DataFrame, batch: DataFrame) -> DataFrame:
        kept = self.histories(before)
        sums = before.filter("slot IS NULL").select("y", "c", "m").unionByName(beaten(batch, *self.of, kept)).groupBy("y").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
        both = merge_histories(kept, history(batch, *self.of, self.depth, self.policy))
        return both.unionByName(sums, allowMissingColumns=True).select(*[c.split()[0] for c in self.columns.split(", ")])

    def auc(self) -> DataFrame:
        return estimate(self.state().filter("slot IS NULL"))
