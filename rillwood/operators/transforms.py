"""Event transforms: functions from DataFrame to DataFrame, composed left to right."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwood.functions.dates import date_parts

Transform = Callable[[DataFrame], DataFrame]
#: Metadata key under which a derived column names the attribute it comes from.
PARENT = "parent_attribute"


def identity(df: DataFrame) -> DataFrame:
    return df


def pipeline(*steps: Transform) -> Transform:
    """All steps in turn; also what a stream's own list of event transforms is."""
    return lambda df: reduce(lambda d, f: d.transform(f), steps, df)


def _json_path(path: str) -> str:
    """a.b[0].c or [a][b] as a JSON path."""
    dotted = path.replace("][", ".").strip("[]") if path.startswith("[") else path
    return f"$.{dotted}"


def extract_fields(json: str, fields: dict[str, str | None]) -> Transform:
    """Columns from a JSON string column, by name; without a path the field of that name. Missing paths are null. A column
    of structs is read in the same way."""

    def run(df: DataFrame) -> DataFrame:
        if dict(df.dtypes)[json].startswith("struct"):
            return df.withColumns({n: F.col(f"{json}.{(p or n).replace('][', '.').strip('[]')}") for n, p in fields.items()})
        return df.withColumns({n: F.get_json_object(json, _json_path(p or n)) for n, p in fields.items()})

    return run


def keep_fields(fields: list[str]) -> Transform:
    return lambda df: df.select(*[c for c in fields if c in df.columns])


def drop_where_null(fields: list[str]) -> Transform:
    return lambda df: df.dropna(subset=[c for c in fields if c in df.columns])


def array_fields(array: str, headers: list[str]) -> Transform:
    """Columns from the elements of an array; elements it lacks are null."""
    return lambda df: df.withColumns({h: F.get(F.col(array), F.lit(i)) for i, h in enumerate(headers)})


def expand_dates(column: str, zone: str | None = None, drop: bool = True) -> Transform:
    """The parts of a date as columns of their own whose metadata names it."""

    def run(df: DataFrame) -> DataFrame:
        parts = date_parts(F.col(column), column, zone)
        names = [f"{column}_{k}" for k in ("y", "m", "d", "dm", "h", "mi", "s", "t", "tzo")]
        out = df.select("*", *[p.alias(n, metadata={PARENT: column}) for p, n in zip(parts, names, strict=True)])
        return out.drop(column) if drop else out

    return run


def to_events(df: DataFrame, order: str, ts: str, types: dict[str, str] | None = None) -> DataFrame:
    """Wide rows as events: (order, ts, data) with data an array of (name, value, type); null values have no entry."""
    types = types or {}
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.lit(types.get(c)).cast("string").alias("type"))) for c in df.columns if c not in (order, ts)]
    return df.select(order, ts, F.filter(F.array(*entries), lambda e: e.isNotNull()).alias("data"))


def to_long(events: DataFrame, order: str) -> DataFrame:
    """(order, name, value, type), one row an entry."""
    return events.select(order, F.explode("data").alias("e")).select(order, "e.*")


def parents(df: DataFrame) -> dict[str, str]:
    """Derived column -> the attribute it comes from, and every other column to itself."""
    return {f.name: f.metadata.get(PARENT, f.name) for f in df.schema}


def group_by_parent(importances: DataFrame, lineage: dict[str, str]) -> DataFrame:
    """(attribute, importance) of derived attributes summed under their parents."""
    pairs = [F.lit(x) for kv in lineage.items() for x in kv]
    parent = F.coalesce(F.create_map(*pairs)[F.col("attribute")], F.col("attribute")) if pairs else F.col("attribute")
    return importances.groupBy(parent.alias("attribute")).agg(F.sum("importance").alias("importance"))


def top_fields(importances: DataFrame, k: int = -1) -> DataFrame:
    """The k most important attributes; all of them for k under 0."""
    ordered = importances.orderBy(F.desc("importance"), "attribute")
    return ordered if k < 0 else ordered.limit(k)


def vectorised(df: DataFrame, features: list[str], label: str | None, key: str) -> DataFrame:
    """(key, features array<double>, label): NaN for missing values, a null label where there is none."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return df.select(key, x.alias("features"), (F.col(label) if label in df.columns else F.lit(None)).alias("label"))


def unvectorised(df: DataFrame, vector: str, features: list[str], keep_derived: dict[str, str] | None = None) -> DataFrame:
    """Columns from a vector; with a lineage only attributes that aren't derived."""
    names = [c for c in features if keep_derived is None or keep_derived.get(c, c) == c]
    value = lambda i: F.when(~F.isnan(F.get(F.col(vector), F.lit(i))), F.get(F.col(vector), F.lit(i)))
    return df.withColumns({c: value(features.index(c)) for c in names})


def unmapped(distribution: Column, labels: list[str]) -> Column:
    """An array of class weights as a map by label."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), distribution)


def fill_blanks(df: DataFrame, columns: list[str], fit_predict: Callable[[DataFrame, str, list[str]], DataFrame], key: str) -> DataFrame:
    """``df`` with missing cells of ``columns`` predicted from the others: for each column ``fit_predict(df, target,
    features)`` gives (key, prediction)."""
    out = df
    for c in columns:
        guess = fit_predict(df, c, [x for x in columns if x != c]).select(key, F.col("prediction").alias("_p"))
        out = out.join(guess, key, "left").withColumn(c, F.coalesce(F.col(c), F.col("_p").cast(df.schema[c].dataType))).drop("_p")
    return out.select(*df.columns)


def drop_ticks(column: str = "tick") -> Transform:
    """Rows that only mark the time are no events."""
    return lambda df: df.filter(F.col(column).isNull()).drop(column) if column in df.columns else df
