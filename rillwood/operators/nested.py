"""Nested JSON as VARIANT: the types of all paths from one pass, and columns by path, without a declared schema.

A path that holds different types keeps them: its column is a VARIANT too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"OBJECT<|ARRAY<|`(?:[^`]|``)*`(?=: )|[^<>,:` ]+(?=: )|[A-Z]+(?:\(\d+,\d+\))?|[<>,:]| +")


def variant(col: Column) -> Column:
    """JSON text as a VARIANT; null where it is none."""
    return F.try_parse_json(col)


def variant_type(df: DataFrame, col: Column) -> DataFrame:
    """One row: the merged type of all values, as text. A partial aggregation."""
    return df.agg(F.schema_of_variant_agg(col).alias("type"))


def paths_of(text: str | None) -> dict[str, str]:
    """The paths of a merged type with what they hold: a scalar type, ARRAY<...>, or VARIANT where types differ. Objects are
    entered, arrays aren't."""
    tokens = [t for t in _TOKEN.findall(text or "VOID") if t.strip()]
    out: dict[str, str] = {}

    def read(at: int, path: str | None) -> tuple[int, str]:
        t = tokens[at]
        if t == "ARRAY<":
            at, inner = read(at + 1, None)
            found = f"ARRAY<{inner}>"
            at += 1
        elif t == "OBJECT<":
            parts, at = [], at + 1
            while tokens[at] != ">":
                if tokens[at] == ",":
                    at += 1
                    continue
                name = tokens[at]
                own = name[1:-1].replace("``", "`") if name.startswith("`") else name
                at, inner = read(at + 2, None if path is None else f"{path}.{own}" if path else own)
                parts.append(f"{name}: {inner}")
            return at + 1, f"OBJECT<{', '.join(parts)}>"
        else:
            at, found = at + 1, t
        if path:
            out[path] = found
        return at, found

    read(0, "")
    return out


#: Spark's types for those of a VARIANT.
_KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "VOID": "string"}


def path_types(df: DataFrame, col: Column) -> dict[str, str]:
    """The types of all paths, from one job whose result is one row."""
    return paths_of(variant_type(df, col).first()[0])


def by_paths(df: DataFrame, col: Column, types: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """``df`` with a column for each path, of its own type; null where a row has none or another type. Arrays and mixed paths
    stay VARIANT, decimals become doubles. Keys with a quote or a bracket aren't reached."""
    out = []
    for path, kind in (path_types(df, col) if types is None else types).items():
        spark_kind = _KINDS.get(kind, "double" if kind.startswith("DECIMAL") else "variant")
        steps = "".join(f"['{p}']" for p in path.split("."))
        out.append(F.try_variant_get(col, f"${steps}", spark_kind).alias(f"{prefix}{path}"))
    return df.select("*", *out)
