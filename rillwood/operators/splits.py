"""Split search over histograms as windows: candidate splits, gains, best of each attribute and the Hoeffding test.

A histogram has a row for each (group..., attr, bin) with the weights of the classes (c, an array) or n, s and q (weight, sum
and sum of squares of a numeric target). Its rows are few, whatever the data: bins times attributes times open leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwood.functions.arrays import entropy, total
from rillwood.functions.hashing import md5_int


def class_histogram(df: DataFrame, group: list[str], attr: Column, bin_: Column, label: Column, classes: list) -> DataFrame:
    """(group..., attr, bin, c) of raw rows, one partial aggregation."""
    counts = F.array(*[F.count_if(label == F.lit(k)).cast("double") for k in classes])
    return df.filter(bin_.isNotNull() & label.isNotNull()).groupBy(*group, attr.alias("attr"), bin_.alias("bin")).agg(counts.alias("c"))


def value_histogram(df: DataFrame, group: list[str], attr: Column, bin_: Column, target: Column) -> DataFrame:
    t = target.cast("double")
    return df.filter(bin_.isNotNull() & t.isNotNull()).groupBy(*group, attr.alias("attr"), bin_.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(t).alias("s"), F.sum(t * t).alias("q"))


def _windows(group: list[str]) -> tuple:
    own = W.partitionBy(*group, "attr")
    return own, own.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)


def _sum_arrays(col: str, window, size: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(col), F.lit(k))).over(window) for k in range(size)])


def gains_numeric(hist: DataFrame, group: list[str], classes: int) -> DataFrame:
    """(group..., attr, split, gain, tau) for x <= split: H - tau H(left) - (1 - tau) H(right), not for the last bin."""
    own, upto = _windows(group)
    h = hist.withColumns({"all_": _sum_arrays("c", own, classes), "left_": _sum_arrays("c", upto, classes)})
    h = h.withColumn("right_", F.zip_with("all_", "left_", lambda a, b: a - b))
    tau = total(F.col("left_")) / total(F.col("all_"))
    gain = entropy(F.col("all_")) - tau * entropy(F.col("left_")) - (1 - tau) * entropy(F.col("right_"))
    return h.filter(total(F.col("right_")) > 0).select(*group, "attr", F.col("bin").alias("split"), gain.alias("gain"), tau.alias("tau"))


def gains_categoric(hist: DataFrame, group: list[str], classes: int) -> DataFrame:
    """One row an attribute: the value v with the least (m/M) H(v), the first of equals; gain H (1 - m/M) - (m/M) H(v)."""
    own, _ = _windows(group)
    h = hist.withColumn("all_", _sum_arrays("c", own, classes))
    m = total(F.col("c")) / total(F.col("all_"))
    h = h.withColumns({"m": m, "cost": m * entropy(F.col("c")), "whole": entropy(F.col("all_"))})
    best = h.groupBy(*group, "attr").agg(F.min(F.struct("cost", "bin", "m", "whole")).alias("b"))
    return best.select(*group, "attr", F.col("b.bin").alias("split"), (F.col("b.whole") * (1 - F.col("b.m")) - F.col("b.cost")).alias("gain"), F.col("b.m").alias("tau"))


def scores_numeric(hist: DataFrame, group: list[str]) -> DataFrame:
    """(group..., attr, split, gain, tau) for a numeric target: l^2/m + (L-l)^2/(M-m), not for the last bin."""
    own, upto = _windows(group)
    h = hist.withColumns({"mm": F.sum("n").over(own), "ll": F.sum("s").over(own), "m": F.sum("n").over(upto), "l": F.sum("s").over(upto)})
    gain = F.col("l") * F.col("l") / F.col("m") + (F.col("ll") - F.col("l")) * (F.col("ll") - F.col("l")) / (F.col("mm") - F.col("m"))
    return h.filter("mm > m").select(*group, "attr", F.col("bin").alias("split"), gain.alias("gain"), (F.col("m") / F.col("mm")).alias("tau"))


def scores_categoric(hist: DataFrame, group: list[str]) -> DataFrame:
    """One row an attribute: the value with the largest l^2/m, the first of equals; the rest's term is left out where the
    rest has no rows or its sum is 0 within 1e-6."""
    own, _ = _windows(group)
    h = hist.withColumns({"mm": F.sum("n").over(own), "ll": F.sum("s").over(own), "worth": -F.col("s") * F.col("s") / F.col("n")})
    b = h.groupBy(*group, "attr").agg(F.min(F.struct("worth", "bin", "n", "s", "mm", "ll")).alias("b")).select(*group, "attr", "b.*")
    rest = F.when((F.abs(F.col("ll") - F.col("s")) < 1e-6) | (F.col("mm") <= F.col("n")), 0.0).otherwise(F.try_divide((F.col("ll") - F.col("s")) * (F.col("ll") - F.col("s")), F.col("mm") - F.col("n")))
    return b.select(*group, "attr", F.col("bin").alias("split"), (rest - F.col("worth")).alias("gain"), (F.col("n") / F.col("mm")).alias("tau"))


def best_splits(gains: DataFrame, group: list[str]) -> DataFrame:
    """The best split of each attribute, the least of equals."""
    best = gains.groupBy(*group, "attr").agg(F.min(F.struct((-F.round("gain", 12)).alias("g"), "split", "gain", "tau")).alias("b"))
    return best.select(*group, "attr", F.col("b.split").alias("split"), F.col("b.gain").alias("gain"), F.col("b.tau").alias("tau"))


def top_two(best: DataFrame, group: list[str]) -> DataFrame:
    """(group..., attr, split, gain, tau, second): the best attribute and the gain of the next one, null without one."""
    order = W.partitionBy(*group).orderBy(F.desc(F.round("gain", 12)), "attr") if group else W.orderBy(F.desc(F.round("gain", 12)), "attr")
    ranked = best.withColumns({"r": F.row_number().over(order), "second": F.lead("gain").over(order)})
    return ranked.filter("r = 1").drop("r")


def hoeffding_epsilon(n: Column | float, spread: Column | float, delta: float) -> Column:
    """How far a mean of n observations may be off with confidence 1 - delta; 0 for a delta of 1."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.lit(0.0) if delta == 1.0 else lit(spread) * F.sqrt(F.lit(math.log(1 / delta)) / (2 * lit(n)))


def class_spread(labels: int) -> float:
    return math.log2(1 + labels)


def decide(top: DataFrame, n: str, spread: Column | float, delta: float = 1e-5, tau: float = 0.05) -> DataFrame:
    """Adds eps and splits: whether the best attribute beats the next by more than chance, or the two can't be told apart."""
    eps = hoeffding_epsilon(F.col(n), spread, delta)
    clear = F.col("second").isNull() | (F.col("gain") - F.col("second") > F.col("eps")) | (F.col("eps") < tau)
    return top.withColumn("eps", eps).withColumn("splits", (F.col("gain") > F.col("eps")) & clear)


def uniform_candidates(df: DataFrame, column: str, splits: int = 16) -> DataFrame:
    """(split): up to splits - 1 thresholds of equal mass."""
    cuts = F.percentile_approx(F.col(column), [k / splits for k in range(1, splits)], 10_000)
    return df.agg(F.array_distinct(cuts).alias("a")).select(F.explode("a").alias("split"))


def random_candidate(candidates: DataFrame, seed: int) -> DataFrame:
    """One of the candidates by a hash, as extremely randomised trees take it."""
    return candidates.orderBy(md5_int(F.concat_ws("|", F.lit(str(seed)), F.col("split").cast("string"))), "split").limit(1)


def random_attributes(attrs: DataFrame, group: list[str], attr: str, most: int, seed: int) -> DataFrame:
    """``most`` attributes of each group by a hash of group, attribute and seed."""
    order = W.partitionBy(*group).orderBy(md5_int(F.concat_ws("|", *[F.col(g).cast("string") for g in group], attr, F.lit(str(seed)))), attr)
    return attrs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")
