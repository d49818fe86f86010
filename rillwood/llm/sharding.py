"""Shards by a Feistel permutation with cycle walking over global row numbers.

Row r of n goes to place p(r), where p permutes 0..n-1; shard and slot are p mod S and p div S. Any row's place is
computable from its number and the seed alone, counts differ by one at most, and slots have no gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, write_table

ROUNDS = 8


def _keys(seed: int) -> list[tuple[int, int]]:
    x, out = (seed * 2 + 1) & 0xFFFFFFFFFFFFFFFF, []
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
            pair.append((z ^ (z >> 31)) | 1)
        out.append(tuple(pair))
    return out


def feistel(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of row numbers 0..n-1 under the seed's permutation of 0..n-1.

    A balanced network permutes the smallest even power of two that holds n; a place outside 0..n-1 walks on along its
    cycle until it is inside, which keeps the mapping one to one. The power is under 4n, so walks are short.
    """
    half = max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(np.uint64(a), np.uint64(b)) for a, b in _keys(seed)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for a, b in keys:
            mixed = (right ^ b) * a
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << h) | right

    with np.errstate(over="ignore"):
        place = once(numbers.astype(np.uint64))
        while len(outside := np.flatnonzero(place >= np.uint64(n))):
            place[outside] = once(place[outside])
    return place.astype(np.int64)


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus 1 and unsigned CRC-32 of each whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def number_rows(df: DataFrame, keys: list[str], name: str, parts: int = 4096) -> tuple[DataFrame, int]:
    """Adds each row's global number 0..n-1 in the order (hash of the keys mod ``parts``, keys); returns n too.

    Each of ``parts`` pieces is numbered by itself after one shuffle; the counts of the pieces before it (a
    broadcast of at most ``parts`` rows) are added. Rows alike in every key share their numbers among themselves
    in any way, which no output can tell.
    """
    piece, before = free_name(df, "piece", "before")
    df = df.withColumn(piece, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    counts = write_table(df.groupBy(piece).count(), "pieces")
    n = counts.agg(F.sum("count")).first()[0] or 0
    starts = counts.select(piece, (F.sum("count").over(W.orderBy(piece)) - F.col("count")).alias(before))
    order = W.partitionBy(piece).orderBy(*[F.col(k) for k in keys])
    numbered = df.withColumn(name, F.row_number().over(order) - 1).join(F.broadcast(starts), piece)
    return numbered.withColumn(name, F.col(name) + F.col(before)).drop(piece, before), n


def permuted(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(feistel(v.to_numpy(), n, seed))

    return place(number)


def shard(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (columns of these names are replaced).

    ``keys`` must tell rows apart as far as that matters; null keys are values like others, repeated rows each get a slot
    of their own, an empty table gives an empty result.
    """
    df = df.drop("shard", "slot")
    (number,) = free_name(df, "row_number")
    out, n = number_rows(df, keys, number)
    out = out.withColumn(number, permuted(F.col(number), n, seed))
    return out.withColumns({"shard": (F.col(number) % shards).cast("int"), "slot": F.expr(f"`{number}` div {shards}L")}).drop(number)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The digest of each document's place: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard counts are at most one apart. Null text has size 1; other columns aren't read.
    """
    facts = write_table(text_facts(docs), "facts")
    out = shard(facts, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
