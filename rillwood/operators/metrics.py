"""Running quality of predictions: all of it one or two partial aggregations over (actual, predicted) columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered, running_sums

UNKNOWN = "?"
#: Windows of the exponential averages: weight 1/1 (the mean), 1/2, 1/4, 1/8, 1/16.
WEIGHTS = (1, 2, 4, 8, 16)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n_correct, n_total, accuracy over rows with an actual label; 0 for none."""
    right = F.coalesce((F.col(actual) == F.col(predicted)).cast("int"), F.lit(0))
    out = df.filter(F.col(actual).isNotNull()).agg(F.coalesce(F.sum(right), F.lit(0)).alias("n_correct"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_total")), F.lit(0.0)))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    return df.groupBy(name(actual).alias("actual"), name(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    return confusion_matrix(df, actual, predicted).groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision (of those predicted), recall (of those actual) and f1; 0 where there are none."""
    m = confusion_matrix(df, actual, predicted)
    sides = m.select(F.explode(F.array(*[F.struct(F.col(c).alias("label"), F.col("n").alias("n"), F.lit(k).alias("side"), (F.col("actual") == F.col("predicted")).alias("hit")) for k, c in enumerate(("actual", "predicted"))])).alias("x")).select("x.*")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = sides.groupBy("label").agg(part((F.col("side") == 0) & F.col("hit")).alias("c"), part(F.col("side") == 0).alias("a"), part(F.col("side") == 1).alias("p"))
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), y), F.lit(0.0))
    out = out.withColumns({"precision": ratio("c", F.col("p")), "recall": ratio("c", F.col("a"))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("label", "precision", "recall", f1.alias("f1"))


def exponential_averages(df: DataFrame, order: str, value: Column, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row: the running averages whose n-th update has weight c / n, for each c, after all rows in order.

    The recursion has the closed form sum over k of c/n * prod (k - j) / (n - j) * x_k for j < c, so it needs each row's
    number and one aggregation. Null until there are c rows.
    """
    rows = _in_order(df, order, value)

    def average(c: int) -> Column:
        w = reduce(lambda a, j: a * ((F.col("k") - j) / (F.col("n") - j)), range(1, c), F.lit(float(c)) / F.col("n"))
        return F.sum(F.when((F.col("n") >= c) & (F.col("k") >= c), w * F.col("x"))).alias(f"exp_avg_{c}")

    return rows.agg(F.max("n").alias("n"), *[average(c) for c in weights])


def ema(df: DataFrame, order: str, value: Column, alpha: float) -> DataFrame:
    """One row: s = alpha * x + (1 - alpha) * s from s = 0, after all rows in order."""
    return _in_order(df, order, value).agg(F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("k")) * F.col("x")).alias("ema"))


def _in_order(df: DataFrame, order: str, value: Column) -> DataFrame:
    """(x, k, n): values with their number in the order, and how many there are."""
    rows = numbered(df.select(F.col(order).alias("_order"), value.cast("double").alias("x")), "_order", "k")
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))  # one row


def regression_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """correlation (0 if there is none), mae, rmse, and how many rows could be predicted."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    d = df.filter(a.isNotNull()).select(a.alias("a"), F.when(~F.isnan(p), p).alias("p"))
    ok, corr = F.col("p").isNotNull(), F.corr("a", "p")
    return d.agg(
        F.coalesce(F.when(~F.isnan(corr), corr), F.lit(0.0)).alias("correlation"), F.avg(F.abs(F.col("a") - F.col("p"))).alias("mae"),
        F.sqrt(F.avg((F.col("a") - F.col("p")) * (F.col("a") - F.col("p")))).alias("rmse"), F.count_if(ok).alias("predictable"), F.count_if(~ok).alias("unpredictable"), F.count(F.lit(1)).alias("total"),
    )


def error_estimate(df: DataFrame, actual: str, predicted: str, regression: bool) -> DataFrame:
    return regression_summary(df, actual, predicted).select(F.col("rmse").alias("error_estimate")) if regression else accuracy(df, actual, predicted).select(F.col("accuracy").alias("error_estimate"))


def auc(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row: the exact area under the ROC curve, ties counting half; null without both classes."""
    d = df.select(positive.cast("int").alias("y"), score.cast("double").alias("s")).filter("y IS NOT NULL AND s IS NOT NULL")
    by = d.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    run = running_sums(by, "s", {"neg_upto": F.col("neg")})
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return run.agg(F.try_divide(won.cast("double"), F.sum("pos") * F.sum("neg")).alias("auc"))


def online_auc(df: DataFrame, order: str, positive: Column, score: Column, depth: int = 10) -> DataFrame:
    """One row: the running estimate after the last row of ``order`` (a unique number), where each score meets the latest
    ``depth`` scores of the other class before it; the share it beats, ties half, is averaged by class. Rows without such
    scores count as a half. Rows with a null class or score are left out; no rows give a half."""
    d = df.select(F.col(order).alias("o"), positive.cast("int").alias("y"), score.cast("double").alias("s")).filter("y IS NOT NULL AND s IS NOT NULL")
    d = running_sums(d, "o", {"pos": F.col("y").cast("bigint"), "neg": 1 - F.col("y").cast("bigint")})
    d = d.select("o", "y", "s", F.when(F.col("y") == 1, F.col("pos")).otherwise(F.col("neg")).alias("k"), F.when(F.col("y") == 1, F.col("neg")).otherwise(F.col("pos")).alias("met"))
    # row k of a class is asked for by its number: a row of the other class has at most `depth` questions
    asks = d.filter("met > 0").select("o", "s", (1 - F.col("y")).alias("y"), F.explode(F.sequence(F.greatest(F.col("met") - (depth - 1), F.lit(1)), "met")).alias("k"))
    found = asks.join(d.select("y", "k", F.col("s").alias("v")), ["y", "k"])
    shares = found.groupBy("o", (1 - F.col("y")).alias("y")).agg(F.avg(F.when(F.col("s") > F.col("v"), 1.0).when(F.col("s") == F.col("v"), 0.5).otherwise(0.0)).alias("m"))
    sums = d.groupBy("y").agg(F.count(F.lit(1)).alias("n")).join(shares.groupBy("y").agg(F.sum("m").alias("t"), F.count(F.lit(1)).alias("c")), "y", "left")
    mean = (F.coalesce("t", F.lit(0.0)) + (F.col("n") - F.coalesce("c", F.lit(0))) / 2) / F.col("n")
    side = lambda y: F.coalesce(F.max(F.when(F.col("y") == y, mean)), F.lit(0.5))
    return sums.agg(((1 + side(1) - side(0)) / 2).alias("auc"))


def entropy_by(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, entropy in bits of the labels)"""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    sums = n.groupBy(group).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    return sums.select(group, (F.log2("t") - F.col("nl") / F.col("t")).alias("entropy"))


def argmax_label(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n): the most frequent label, the least of equals."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label")))
    return n.groupBy(group).agg(best.alias("b")).select(group, F.col("b.label").alias("label"), (-F.col("b.m")).alias("n"))


def prequential_summary(df: DataFrame, actual: str, predicted: str, regression: bool = False, epoch: str | None = None, current: int = 0) -> DataFrame:
    """The summary of a learner's kind over the rows of the current stats epoch; clearing stats is starting a new one."""
    held = df.filter(F.col(epoch) >= current) if epoch else df
    return regression_summary(held, actual, predicted) if regression else accuracy(held, actual, predicted)
