"""Hash functions as column expressions. The md5 ones give the same numbers on any engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range of hashed feature values, and of a hashed attribute on its own.
FEATURE_RANGE, DEFAULT_RANGE = 11, 43


def md5_int(col: Column) -> Column:
    """The first 32 bits of the md5 of a string as a long."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def murmur(col: Column) -> Column:
    return F.hash(col)


def hashed_bucket(col: Column, buckets: int = FEATURE_RANGE, seed: int = 0) -> Column:
    """1 to ``buckets``; null stays null."""
    return 1 + F.pmod(md5_int(F.concat(F.lit(f"{seed}:"), col.cast("string"))), F.lit(buckets))


def poisson_thresholds(rate: float = 1.0, most: int = 12) -> list[float]:
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        out.append(total)
    return out


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the parts, the same wherever and whenever it is computed."""
    return md5_int(F.concat_ws("|", *[p.cast("string") for p in parts])) / F.lit(4294967296.0)


def poisson_weight(*parts: Column, rate: float = 1.0) -> Column:
    """How often an event counts for a tree: Poisson by inversion of a hash, so bagging needs no random state."""
    u, weight = unit_hash(*parts), F.lit(0)
    for t in poisson_thresholds(rate):
        weight = weight + F.when(u >= t, 1).otherwise(0)
    return weight
