"""Vectors, maps and small mathematics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def non_zero(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x != 0))


def plus(a: Column, b: Column) -> Column:
    """Element by element; the shorter is filled with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def scaled(a: Column, by: float | Column) -> Column:
    by = by if isinstance(by, Column) else F.lit(by)
    return F.transform(a, lambda x: x * by)


def decremented(a: Column, at: int) -> Column:
    return F.transform(a, lambda x, i: F.when(i == at, x - 1).otherwise(x))


def argmax(a: Column) -> Column:
    """Place of the largest element, the first of equals; -1 for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1).otherwise(-1)


def entropy(counts: Column) -> Column:
    """Bits, from an array of counts; 0 for an empty one."""
    all_ = total(counts)
    return F.when(all_ > 0, F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / all_ * F.log2(c / all_))).otherwise(0.0)


def non_zero_entries(a: Column) -> Column:
    """(index, value) of the elements that aren't zero."""
    return F.filter(F.transform(a, lambda x, i: F.struct(i.alias("index"), x.alias("value"))), lambda e: e["value"] != 0)


def merged_counts(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def map_argmax(m: Column) -> Column:
    """Key of the largest value, the least key of equals."""
    best = F.array_max(F.map_values(m))
    return F.array_min(F.map_keys(F.map_filter(m, lambda _, v: v == best)))
