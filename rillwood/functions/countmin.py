"""Count-min: how often items came, from a table of fixed size that adds up over partitions, batches and streams.

Each item counts in one cell of each row, chosen by its md5; the least of its cells is never under the true count, and over
it by more than ``error`` times all counts with a probability of at most 1 - ``confidence``. The table is what tasks shuffle
and what a stream keeps: rows times cells numbers, however many items there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _weighed, clean_words, term_counts

#: Where a table of cells keeps how many documents it has counted.
TOTAL = -1


@dataclass(frozen=True)
class CountMin:
    error: float = 0.01
    confidence: float = 0.95

    @property
    def width(self) -> int:
        return math.ceil(2 / self.error)  # half the mass of a row is over twice the mean with a chance of a half at most

    @property
    def depth(self) -> int:
        return max(1, math.ceil(-math.log2(1 - self.confidence)))

    def hashed(self, df: DataFrame, item: Column) -> DataFrame:
        """``df`` with _first and _step: two parts of an item's md5, 32 bits each, worked out once a row."""
        digest = F.md5(item.cast("string"))
        return df.withColumn("_md5", digest).select(*df.columns, *[F.conv(F.substring("_md5", at, 8), 16, 10).cast("bigint").alias(name) for name, at in (("_first", 1), ("_step", 9))])

    def places(self) -> list[Column]:
        """The cell of each row for an item that is hashed: the first part and, a row, the second once more."""
        return [F.pmod(F.col("_first") + row * F.col("_step"), F.lit(self.width)).cast("int") for row in range(self.depth)]

    def cells(self, df: DataFrame, item: Column, n: Column | None = None) -> DataFrame:
        """(row, cell, n): ``n`` (1 where it isn't given) of every row of ``df`` at its item's cells; a null item isn't counted.
        One partial aggregation."""
        held = df.select(item.alias("_i"), (F.lit(1) if n is None else n).cast("bigint").alias("n")).filter("_i IS NOT NULL")
        placed = self.hashed(held, F.col("_i"))
        cells = F.array(*[F.struct(F.lit(row).alias("row"), c.alias("cell")) for row, c in enumerate(self.places())])
        return placed.select("n", F.explode(cells).alias("c")).groupBy("c.row", "c.cell").agg(F.sum("n").alias("n"))

    def estimated(self, df: DataFrame, item: Column, cells: DataFrame, name: str = "estimate") -> DataFrame:
        """``df`` with each item's estimate, from the cells as one array of rows times cells numbers."""
        size = self.width * self.depth
        held = cells.filter(F.col("row") >= 0).select((F.col("row") * self.width + F.col("cell")).alias("id"), "n")
        dense = df.sparkSession.range(size).join(held, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n")))).alias("_a"))
        table = dense.select(F.transform("_a", lambda x: x["n"])).scalar()  # one row, worked out once and looked up in place
        found = [F.get(table, row * self.width + c) for row, c in enumerate(self.places())]
        return self.hashed(df, item).withColumn(name, F.least(*found) if self.depth > 1 else found[0]).drop("_first", "_step")


def merge_cells(*tables: DataFrame) -> DataFrame:
    """Tables of the same settings as one."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def document_cells(df: DataFrame, text: str, settings: CountMin = CountMin()) -> DataFrame:
    """In how many texts each word is, and how many texts there are. No word is shuffled: a text's own are made distinct in
    its row."""
    words = df.select(F.explode(F.array_distinct(clean_words(F.col(text)))).alias("term"))
    total = df.agg(F.lit(TOTAL).alias("row"), F.lit(0).alias("cell"), F.count(F.lit(1)).alias("n"))
    return settings.cells(words, F.col("term")).unionByName(total)


def tfidf_counted(df: DataFrame, key: str, text: str, cells: DataFrame, settings: CountMin = CountMin(), log_tf: bool = True, binary: bool = False, min_df: float = 0.0, max_df: float = 1.0) -> DataFrame:
    """(key, term, tf, df, weight) with document shares by the cells, which may have counted more than ``df``. A share is at
    most 1: an estimate over the number of documents says all."""
    docs = F.broadcast(cells.filter(F.col("row") == TOTAL).agg(F.sum("n").alias("_docs")))  # one row
    found = settings.estimated(term_counts(df, key, text), F.col("term"), cells, "_with").crossJoin(docs)
    share = F.least(F.lit(1.0), F.col("_with") / F.col("_docs"))
    return _weighed(found, share, log_tf, binary, min_df, max_df).select(key, "term", "tf", "df", "weight")
