"""A mergeable streaming histogram with targets, after Ben-Haim and Tom-Tov, and its use as a grouped aggregate.

Bins are (mean, count, target sums) in order of their means; inserting past the limit joins the two bins with the smallest
gap. A target is nothing, a number (sum and sum of squares), a category (counts by label) or a group of those.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


class SketchError(ValueError):
    """A sketch is asked for what it can't tell."""


class MixedInsertError(SketchError):
    """Targets of different kinds were inserted into one sketch."""


class SumOutOfRangeError(SketchError):
    """A sum was asked of an empty sketch or at NaN."""


SIMPLE, NUMERIC, CATEGORICAL, GROUP = "simple", "numeric", "categorical", "group"


def kind_of(target) -> str:
    if target is None:
        return SIMPLE
    if isinstance(target, (list, tuple)):
        return GROUP
    return NUMERIC if isinstance(target, (int, float)) and not isinstance(target, bool) else CATEGORICAL


def lift(target, kind: str):
    """The sums that one target contributes."""
    if kind == SIMPLE:
        return None
    if kind == GROUP:
        return [(k, lift(t, k)) for t in target for k in [kind_of(t)]]
    if kind == NUMERIC:
        missing = target is None or math.isnan(target)
        return [0.0, 0.0, 1.0] if missing else [float(target), float(target) ** 2, 0.0]
    return {str(target): 1.0}


def add(a, b, scale: float = 1.0):
    """a + scale * b for sums of one kind; either may be None."""
    if b is None:
        return a
    if isinstance(b, dict):
        out = dict(a or {})
        for k, v in b.items():
            out[k] = out.get(k, 0.0) + scale * v
        return out
    if b and isinstance(b[0], (tuple, list)):
        return [(k, add(x[1] if x else None, y, scale)) for x, (k, y) in zip(a or [None] * len(b), b, strict=True)]
    return [x + scale * y for x, y in zip(a or [0.0] * len(b), b, strict=True)]


class Sketch:
    def __init__(self, max_bins: int = 64, gap_weighted: bool = False, freeze: float | None = None, categories: Iterable[str] | None = None, group: list[str] | None = None):
        self.max_bins, self.gap_weighted, self.freeze = max_bins, gap_weighted, freeze
        self.categories, self.group = set(map(str, categories)) if categories is not None else None, group
        self.kind: str | None = GROUP if group else CATEGORICAL if categories is not None else None
        self.means: list[float] = []
        self.bins: dict[float, list] = {}  # mean -> [count, sums]
        self.min, self.max = math.inf, -math.inf
        self.missing, self.missing_sums = 0.0, None

    # -- inserting ---------------------------------------------------------------------------------------------------

    def insert(self, value: float | None, target=None, count: float = 1.0) -> Sketch:
        kind = kind_of(target)
        if self.kind is None:
            self.kind = kind
        elif kind != self.kind and not (self.kind == NUMERIC and target is None):
            raise MixedInsertError(f"a {kind} target in a sketch of {self.kind} targets")
        if self.categories is not None and str(target) not in self.categories:
            raise MixedInsertError(f"{target!r} is none of the sketch's categories")
        if self.group and [kind_of(t) for t in target] != self.group:
            raise MixedInsertError("the group's targets are of other kinds")
        sums = add(None, lift(target, self.kind), count)
        if value is None or math.isnan(value):
            self.missing += count
            self.missing_sums = add(self.missing_sums, sums)
        else:
            self.insert_bin(float(value), count, sums)
        return self

    def insert_bin(self, mean: float, count: float, sums=None, low: float | None = None, high: float | None = None) -> None:
        self.min, self.max = min(self.min, mean if low is None else low), max(self.max, mean if high is None else high)
        frozen = self.freeze is not None and self.total >= self.freeze and self.means
        if frozen and mean not in self.bins:
            mean = self._nearest(mean)
        if mean in self.bins:
            b = self.bins[mean]
            b[0] += count
            b[1] = add(b[1], sums)
        else:
            insort(self.means, mean)
            self.bins[mean] = [count, sums]
            self._compress()

    def _nearest(self, mean: float) -> float:
        i = bisect_left(self.means, mean)
        near = self.means[max(0, i - 1) : i + 1]
        return min(near, key=lambda m: (abs(m - mean), m))

    def _gap(self, i: int) -> float:
        a, b = self.means[i], self.means[i + 1]
        return (b - a) * (math.log(math.e + min(self.bins[a][0], self.bins[b][0])) if self.gap_weighted else 1.0)

    def _compress(self) -> None:
        while len(self.means) > self.max_bins:
            i = min(range(len(self.means) - 1), key=self._gap)
            (a, b), x, y = self.means[i : i + 2], self.bins.pop(self.means[i]), self.bins.pop(self.means[i + 1])
            del self.means[i : i + 2]
            n = x[0] + y[0]
            mean = (a * x[0] + b * y[0]) / n
            sums = add(x[1], y[1])
            if mean in self.bins:  # only by rounding
                self.bins[mean] = [self.bins[mean][0] + n, add(self.bins[mean][1], sums)]
            else:
                insort(self.means, mean)
                self.bins[mean] = [n, sums]

    def merge(self, other: Sketch) -> Sketch:
        if self.categories is not None and other.categories is not None and self.categories != other.categories:
            raise MixedInsertError("the sketches have other categories")
        if self.kind and other.kind and self.kind != other.kind:
            raise MixedInsertError(f"sketches of {self.kind} and {other.kind} targets")
        self.kind = self.kind or other.kind
        limit, self.max_bins = self.max_bins, 1 << 60  # all first, then joined once
        for m in other.means:
            self.insert_bin(m, *other.bins[m])
        self.max_bins = limit
        self._compress()
        self.min, self.max = min(self.min, other.min), max(self.max, other.max)
        self.missing += other.missing
        self.missing_sums = add(self.missing_sums, other.missing_sums)
        return self

    # -- looking up --------------------------------------------------------------------------------------------------

    @property
    def total(self) -> float:
        return sum(b[0] for b in self.bins.values())

    @property
    def total_sums(self):
        out = None
        for b in self.bins.values():
            out = add(out, b[1])
        return out

    def first(self) -> float | None:
        return self.means[0] if self.means else None

    def last(self) -> float | None:
        return self.means[-1] if self.means else None

    def get(self, mean: float) -> list | None:
        return self.bins.get(mean)

    def floor(self, p: float) -> float | None:
        i = bisect_left(self.means, p)
        return p if p in self.bins else self.means[i - 1] if i else None

    def ceiling(self, p: float) -> float | None:
        i = bisect_left(self.means, p)
        return self.means[i] if i < len(self.means) else None

    def lower(self, p: float) -> float | None:
        i = bisect_left(self.means, p)
        return self.means[i - 1] if i else None

    def higher(self, p: float) -> float | None:
        i = bisect_left(self.means, p) + (p in self.bins)
        return self.means[i] if i < len(self.means) else None

    def labels(self) -> list[str]:
        return sorted(self.total_sums or {}) if self.kind == CATEGORICAL else []

    def group_kinds(self) -> list[str]:
        return [k for k, _ in self.total_sums or []] if self.kind == GROUP else []

    # -- sums and densities ------------------------------------------------------------------------------------------

    def _ends(self) -> list[tuple[float, float, object]]:
        """The bins between empty ones at the extremes, so every value has a bin on either side."""
        return [(self.min, 0.0, None), *((m, *self.bins[m]) for m in self.means), (self.max, 0.0, None)]

    def extended_sum(self, p: float) -> tuple[float, object]:
        """How many values, and which target sums, are up to p, by trapezes between bins."""
        if not self.means or math.isnan(p):
            raise SumOutOfRangeError("no values, or none to compare with")
        if p < self.min:
            return 0.0, None
        if p >= self.max:
            return self.total, self.total_sums
        count, sums = 0.0, None
        ends = self._ends()
        for (m0, c0, s0), (m1, c1, s1) in zip(ends, ends[1:], strict=False):
            if p < m1:
                r = (p - m0) / (m1 - m0)
                # bins at the extremes are empty: half of a bin lies on each side of its mean
                part = lambda a, b: a / 2 + a * r + (b - a) * r * r / 2  # noqa: B023, E731
                here = add(add(None, s0, 0.5 + r - r * r / 2), s1, r * r / 2)
                return count + part(c0, c1), add(sums, here)
            count += c0
            sums = add(sums, s0)
        return self.total, self.total_sums

    def sum(self, p: float) -> float:
        return self.extended_sum(p)[0]

    def extended_density(self, p: float) -> tuple[float, object]:
        """The slope of the sum; at a bin the mean of both sides, infinite if there is one value only."""
        if not self.means or p < self.min or p > self.max:
            return 0.0, None
        if self.min == self.max:
            return math.inf, self.total_sums
        ends = self._ends()

        def slope(a, b, at: float):
            (m0, c0, s0), (m1, c1, s1) = a, b
            r, w = (at - m0) / (m1 - m0), m1 - m0
            return (c0 + (c1 - c0) * r) / w, add(add(None, s0, (1 - r) / w), s1, r / w)

        pairs = [(a, b) for a, b in zip(ends, ends[1:], strict=False) if b[0] > a[0]]
        touching = [slope(a, b, p) for a, b in pairs if a[0] <= p <= b[0]]
        n = len(touching)
        sums = None
        for _, s in touching:
            sums = add(sums, s, 1 / n)
        return math.fsum(d for d, _ in touching) / n, sums

    def density(self, p: float) -> float:
        return self.extended_density(p)[0]

    def average_target(self, p: float):
        """Target sums for one value at p."""
        d, sums = self.extended_density(p)
        return add(None, sums, 1 / d) if d and math.isfinite(d) else add(None, sums, 1 / self.total) if d else None

    def inverse_sum(self, wanted: float) -> float:
        """The value up to which there are ``wanted`` values: the root of a quadratic between two bins."""
        if not self.means:
            raise SumOutOfRangeError("no values")
        if wanted <= 0:
            return self.min
        if wanted >= self.total:
            return self.max
        count, ends = 0.0, self._ends()
        for (m0, c0, _), (m1, c1, _) in zip(ends, ends[1:], strict=False):
            upto = count + (c0 + c1) / 2
            if wanted <= upto and m1 > m0:
                a, b, c = (c1 - c0) / 2, c0, count - wanted
                r = -c / b if abs(a) < 1e-12 and b else (-b + math.sqrt(max(0.0, b * b - 4 * a * c))) / (2 * a) if a else 0.0
                return m0 + min(1.0, max(0.0, r)) * (m1 - m0)
            count = upto
        return self.max

    def percentiles(self, *shares: float) -> dict[float, float]:
        return {p: self.inverse_sum(self.total * p) for p in shares}

    def uniform(self, n: int) -> list[float]:
        """Up to n - 1 values that cut the sketch into parts of equal mass; fewer where the bins at the ends are heavy."""
        if not self.means:
            return []
        gap = max(self.total / n, max(self.bins[self.means[0]][0], self.bins[self.means[-1]][0]) / 2)
        out, at = [], gap
        while at <= self.total - gap + 1e-9:
            out.append(self.inverse_sum(at))
            at += gap
        return [x for i, x in enumerate(out) if i == 0 or x > out[i - 1]]

    # -- as data -----------------------------------------------------------------------------------------------------

    def to_json(self, digits: int | None = None) -> str:
        cut = lambda v: round(v, digits) if digits is not None and isinstance(v, float) else [cut(x) for x in v] if isinstance(v, (list, tuple)) else {k: cut(x) for k, x in v.items()} if isinstance(v, dict) else v
        state = {"max_bins": self.max_bins, "gap_weighted": self.gap_weighted, "freeze": self.freeze, "categories": sorted(self.categories) if self.categories is not None else None, "group": self.group, "kind": self.kind}
        state |= {"bins": [[m, *self.bins[m]] for m in self.means], "min": self.min, "max": self.max, "missing": self.missing, "missing_sums": self.missing_sums}
        return json.dumps(cut(state))

    @classmethod
    def from_json(cls, text: str) -> Sketch:
        d = json.loads(text)
        s = cls(d["max_bins"], d["gap_weighted"], d["freeze"], d["categories"], d["group"])
        s.kind, s.min, s.max, s.missing, s.missing_sums = d["kind"], d["min"], d["max"], d["missing"], d["missing_sums"]
        for m, c, t in d["bins"]:
            s.means.append(m)
            s.bins[m] = [c, t]
        return s

    def __str__(self) -> str:
        return "; ".join(f"{m:.5f}: {self.bins[m][0]:g}" for m in self.means)


def sketch_by(df: DataFrame, group: list[str], value: str, target: str | None = None, max_bins: int = 64, **options) -> DataFrame:
    """(group..., sketch): a sketch of each group as JSON. Every task makes partial sketches of its rows, so what is
    shuffled, and what one merge holds, is a sketch a task and group, however large the group."""
    t = F.col(target) if target else F.lit(None).cast("string")
    held = df.select(*group, F.col(value).cast("double").alias("_x"), t.alias("_t"))
    n = len(group)
    schema = held.select(*group).withColumn("sketch", F.lit("")).schema

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, Sketch] = {}
        for b in batches:
            # rows alike are inserted as one of their number
            alike = pa.Table.from_batches([b]).group_by(b.schema.names, use_threads=False).aggregate([([], "count_all")]).sort_by([(c, "ascending") for c in b.schema.names])
            for *row, count in zip(*(c.to_pylist() for c in alike.select([*b.schema.names, "count_all"]).columns), strict=True):
                made.setdefault(tuple(row[:n]), Sketch(max_bins, **options)).insert(row[n], row[n + 1], float(count))
        keys = list(made)
        cols = [pa.array([k[i] for k in keys], b_type) for i, b_type in enumerate(types)] + [pa.array([made[k].to_json() for k in keys], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    types = [to_arrow_type(f.dataType) for f in schema.fields[:n]]

    @F.pandas_udf("string")
    def merged(parts: pd.Series) -> str:
        out = None
        for p in sorted(parts):
            out = Sketch.from_json(p) if out is None else out.merge(Sketch.from_json(p))
        return out.to_json() if out else Sketch(max_bins, **options).to_json()

    return held.mapInArrow(partial, schema).groupBy(*group).agg(merged("sketch").alias("sketch"))


def merge_sketches(sketches: DataFrame, group: list[str], sketch: str = "sketch", max_bins: int = 64) -> DataFrame:
    """(group..., sketch): the sketches of a group as one of ``max_bins`` bins. All bins come together before any are joined, so
    the order of the sketches doesn't matter."""

    @F.pandas_udf("string")
    def merged(parts: pd.Series) -> str:
        out = None
        for p in sorted(parts.dropna()):
            one = Sketch.from_json(p)
            one.max_bins = 1 << 60
            out = one if out is None else out.merge(one)
        out = out or Sketch(max_bins)
        out.max_bins = max_bins
        out._compress()
        return out.to_json()

    return sketches.groupBy(*group).agg(merged(sketch).alias("sketch"))


def sketch_numbers(sketch: str, what: str, *args: float):
    """A column with what the sketch column says: sum, density, inverse_sum at the first argument; percentiles or uniform as
    arrays."""

    @F.pandas_udf("array<double>")
    def ask(col: pd.Series) -> pd.Series:
        def one(text: str) -> list[float]:
            s = Sketch.from_json(text)
            if what == "percentiles":
                return list(s.percentiles(*args).values())
            got = s.uniform(int(args[0])) if what == "uniform" else getattr(s, what)(*args)
            return got if isinstance(got, list) else [got]

        return col.map(one)

    return ask(F.col(sketch))


def value_bins(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., mean, n): a bin for each value, counted exactly by one partial aggregation."""
    held = df.select(*group, F.col(value).cast("double").alias("mean")).filter("mean IS NOT NULL")
    return held.groupBy(*group, "mean").agg(F.count(F.lit(1)).cast("double").alias("n"))


def native_histogram(df: DataFrame, group: list[str], value: str, bins: int = 64) -> DataFrame:
    """The case without targets wholly in the engine: (group..., bins array<struct<x, y>>). Up to ``bins`` values of a group are
    counted exactly; the engine's own histogram, whose merged parts round means and repeat them, stands for more."""
    order = F.row_number().over(W.partitionBy(*group).orderBy("mean"))
    first = value_bins(df, group, value).withColumn("_r", order).filter(F.col("_r") <= bins + 1)
    few = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col("mean").alias("x"), F.col("n").alias("y")))).alias("_few"))
    whole = df.groupBy(*group).agg(F.histogram_numeric(F.col(value).cast("double"), F.lit(bins)).alias("_whole")).alias("w")
    same = [F.col(f"w.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    return whole.join(few.alias("f"), same, "left").select(*[f"w.{g}" for g in group], F.when(F.size("_few") <= bins, F.col("_few")).otherwise(F.col("_whole")).alias("bins"))


def bin_rows(df: DataFrame, sketch: str) -> DataFrame:
    """``df`` without its sketch column, a row a bin: mean, n and the sums of a numeric target (null without one)."""
    bins = F.from_json(F.get_json_object(sketch, "$.bins"), "array<array<string>>")
    one = df.withColumn("_b", F.explode(bins)).drop(sketch)
    at = lambda k: F.get("_b", F.lit(k))
    return one.select("*", at(0).cast("double").alias("mean"), at(1).cast("double").alias("n"), F.from_json(at(2), "array<double>").alias("sums")).drop("_b")
