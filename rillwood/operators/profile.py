"""Attribute profiles, schema inference, dictionaries and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwood.sources.work import written

#: Fixed tokens that stand for a missing value, whatever their case.
MISSING = ["none", "nan", "na", "n/a", "", "?", "??", "???", "none or unspecified", "unspecified", "unknown"]
#: Types of attributes.
NUMERIC, CATEGORIC, TEXT, DATETIME = "NUMERIC", "CATEGORIC", "TEXT", "DATETIME"


def missing_to_null(col: Column, tokens: list[str] = MISSING) -> Column:
    return F.when(~F.lower(F.trim(col)).isin(tokens), col)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row an attribute, from one pass: name, n, mean, variance (population), min, max. Nulls and NaNs don't count."""
    held = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    one = held.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("p")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.name", "r.p.*")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of the same attributes over parts of the data as one, by Chan's formula."""
    n, m = F.col("n"), F.col("mean")
    s = profiles.groupBy("name").agg(F.sum("n").alias("n"), F.sum(n * m).alias("t"), F.sum(n * (F.col("variance") + m * m)).alias("q"), F.min("min").alias("min"), F.max("max").alias("max"))
    mean = F.try_divide(F.col("t"), F.col("n"))
    return s.select("name", "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.try_divide(F.col("q"), F.col("n")) - mean * mean).alias("variance"), "min", "max")


def infer_types(df: DataFrame, overrides: dict[str, str] | None = None, tokens: list[str] = MISSING) -> DataFrame:
    """(name, idx, type, n_present, n_numeric) of each column from all rows in one pass: CATEGORIC if a value that isn't
    missing is no number, NUMERIC otherwise; an override wins."""
    overrides = overrides or {}
    held = df.select(*[missing_to_null(F.col(f"`{c}`").cast("string"), tokens).alias(c) for c in df.columns])
    one = held.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("n_present"), F.count(F.col(f"`{c}`").try_cast("double")).alias("n_numeric")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("idx"), F.lit(overrides.get(c)).cast("string").alias("given"), F.col(f"`{c}`").alias("p")) for i, c in enumerate(df.columns)])
    out = one.select(F.explode(rows).alias("r")).select("r.name", "r.idx", "r.given", "r.p.*")
    guess = F.when(F.col("n_numeric") < F.col("n_present"), CATEGORIC).otherwise(NUMERIC)
    return out.select("name", "idx", F.coalesce("given", guess).alias("type"), "n_present", "n_numeric")


def infer_event_types(events: DataFrame) -> DataFrame:
    """(name, type) from long events (name, value, type): a stated type wins, two different ones raise an error; without one
    CATEGORIC if a value is no number."""
    g = events.filter("value IS NOT NULL").groupBy("name").agg(F.min("type").alias("lo"), F.max("type").alias("hi"), F.max(F.col("value").try_cast("double").isNull().cast("int")).alias("words"))
    clash = F.raise_error(F.concat(F.lit("types of one attribute differ: "), F.col("name"))).cast("string")
    return g.select("name", F.when(F.col("lo") != F.col("hi"), clash).otherwise(F.coalesce("lo", F.when(F.col("words") == 1, CATEGORIC).otherwise(NUMERIC))).alias("type"))


def _coded(first: DataFrame, order: str) -> DataFrame:
    """``first`` with a code from 0 by (order, value); values of equal order are numbered among themselves."""
    from rillwood.operators.ordering import running_sums

    # one row an order value, numbered in ranges; then its few values
    groups = running_sums(first.groupBy(order).agg(F.count(F.lit(1)).alias("n")), order, {"upto": F.col("n")})
    among = F.row_number().over(W.partitionBy(order).orderBy("value"))
    return first.withColumn("among", among).join(groups, order).withColumn("code", F.col("upto") - F.col("n") + F.col("among") - 1)


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): codes from 0 in the order in which values first come. One row a distinct value; ``order`` is a number.
    ``df`` is read once: the distinct values are written down and then numbered."""
    first = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("first"))
    return _coded(written(first, "dictionary"), "first").select("value", F.col("code").cast("long").alias("code"))


def merge_dictionaries(first: DataFrame, more: DataFrame) -> DataFrame:
    """Codes of ``first`` stay; values only in ``more`` follow in its order."""
    base = first.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("base"))
    new = _coded(more.join(first, "value", "left_anti").withColumnRenamed("code", "old"), "old").crossJoin(F.broadcast(base))  # one row
    return first.select("value", "code").unionByName(new.select("value", (F.col("base") + F.col("code")).alias("code")))


def encode(df: DataFrame, value: str, codes: DataFrame, name: str = "code") -> DataFrame:
    """``df`` with the code of ``value``; null where the dictionary has none."""
    return df.join(codes.select(F.col("value").alias(value), F.col("code").alias(name)), value, "left")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(c) for c in columns])


#: Log of the registers of a distinct count: its standard error is about 1.04 / sqrt(2^SKETCH_BITS), 1.6 %; counts up to some
#: hundreds are exact.
SKETCH_BITS = 12


def sketched_profile(df: DataFrame, columns: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """(name, n, sketch) from one pass: values that aren't null, and a sketch of the distinct ones that can be added to others
    of the same ``bits`` without the values."""
    one = df.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), bits).alias("sketch")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("p")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.name", "r.p.*")


def merge_sketched(profiles: DataFrame) -> DataFrame:
    """Sketched profiles of parts of the data as one."""
    return profiles.groupBy("name").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def sketched_distinct(profiles: DataFrame) -> DataFrame:
    """(name, n, n_distinct)"""
    return profiles.select("name", "n", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long").alias("n_distinct"))


def distinct_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n): how often each value occurs, as text, and a row with a null value and 0 for each attribute. Profiles of
    parts add up to that of the whole without an error; each column is one partial aggregation."""
    nothing = F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n")
    out = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, columns))).alias("name"), *nothing)
    for c in columns:
        found = df.groupBy(F.col(f"`{c}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("value IS NOT NULL")
        out = out.unionByName(found.select(F.lit(c).alias("name"), F.col("value").cast("string").alias("value"), "n"))
    return out


def merge_distinct(profiles: DataFrame) -> DataFrame:
    """Profiles of distinct values of parts of the data as one."""
    return profiles.groupBy("name", "value").agg(F.sum("n").alias("n"))


def exact_distinct(profiles: DataFrame) -> DataFrame:
    """(name, n, n_distinct) of a merged profile of distinct values, one row a value."""
    return profiles.groupBy("name").agg(F.sum("n").alias("n"), F.count("value").alias("n_distinct"))


def _scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.var_pop(c).alias(f"_v_{c}"))])


def normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds c_z for each column: (c - mean) / deviation over the table, 0 where the variance is under 1e-6."""
    out = df.crossJoin(F.broadcast(_scale(df, columns)))  # one row
    z = {f"{c}_z": F.when(F.col(f"_v_{c}") < 1e-6, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.sqrt(f"_v_{c}")) for c in columns}
    return out.withColumns(z).select(*df.columns, *z)


def denormalized(df: DataFrame, z: str, like: DataFrame, column: str, name: str) -> DataFrame:
    """Back from a normalised column, by the mean and deviation of ``like``."""
    s = _scale(like, [column])
    back = F.when(F.col(f"_v_{column}") < 1e-6, 0.0).otherwise(F.col(z) * F.sqrt(f"_v_{column}") + F.col(f"_m_{column}"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, back).drop(f"_m_{column}", f"_v_{column}")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns as their types: numbers by try_cast, dates by cast, missing tokens null; the type is in the metadata."""
    kinds = {NUMERIC: T.DoubleType(), DATETIME: T.TimestampType()}
    out = []
    for c in df.columns:
        k = types.get(c, CATEGORIC)
        v = missing_to_null(F.col(f"`{c}`").cast("string"))
        out.append((v.try_cast(kinds[k]) if k in kinds else v).alias(c, metadata={"attribute_type": k}))
    return df.select(*out)
