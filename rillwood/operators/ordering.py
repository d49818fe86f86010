"""Numbers and running sums over a whole table in an order, without putting it into one partition.

The order is cut at quantiles into ranges; each range is numbered or summed by itself and what lies before it is added. Only
one row a range is ever together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 1024
#: Cuts are found in two steps of about this many comparisons.
_STEP = 32


def _range_of(df: DataFrame, key: str, ranges: int) -> Column:
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), shares, 10 * ranges)).first()[0] or []
    cuts, at = sorted(set(found)), F.col(key).cast("double")
    if not cuts:
        return F.when(at.isNotNull(), 0)
    blocks = [cuts[i : i + _STEP] for i in range(0, len(cuts), _STEP)]
    above = lambda some: F.aggregate(some, F.lit(0), lambda n, c: n + F.when(at > c, 1).otherwise(0))
    block = above(F.lit([b[-1] for b in blocks]))  # blocks that lie wholly below
    inside = F.get(F.array(*[F.lit(b) for b in blocks]), block)
    return F.when(at.isNotNull(), block * _STEP + F.coalesce(above(inside), F.lit(0)))


def running_sums(df: DataFrame, key: str, values: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """``df`` with each value summed over all rows up to its own in the order of ``key``, which must be a number and unique;
    a null key comes first."""
    cut = df.withColumns({"_range": F.coalesce(_range_of(df, key, ranges), F.lit(-1)), **{f"_v_{n}": c for n, c in values.items()}})
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row a range
    starts = cut.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    up_to = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({n: F.sum(f"_v_{n}").over(up_to) for n in values}).join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in values])


def numbered(df: DataFrame, key: str, name: str = "n", ranges: int = RANGES) -> DataFrame:
    """``df`` with each row's number from 1 in the order of ``key``."""
    return running_sums(df, key, {name: F.lit(1).cast("bigint")}, ranges)
