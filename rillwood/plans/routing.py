"""Predictions of forests that fit neither the driver nor a broadcast: rows meet a table of nodes by joins.

Nodes are packed into blocks of a few levels each, an array with the children of place i at 2i and 2i + 1. A row and a tree
meet the block of the root, walk through it inside one expression, and go on with the block they leave it for, so a tree of
24 levels takes four shuffles and not 24. Every row meets the first block of every tree: those are copied and the rows dealt
to the copies. Deeper blocks that many rows meet are left to the join, which can be split as it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwood.sources.work import written

from .model import CATEGORIC, LEAF

LEVELS = 6


def node_blocks(nodes: DataFrame, numeric: list[str], categoric: list[str], levels: int = LEVELS) -> DataFrame:
    """(tree, block, slots): for each node at the top of ``levels`` levels, it and those below it in an array by place.

    ``nodes`` has the columns of model.NODES, with the root of each tree at depth 1; a node is known by tree and number.
    """
    level = (F.col("depth") - 1) % levels
    done = nodes.filter(level == 0).withColumns({"block": F.col("node"), "place": F.lit(1)})
    found = done
    for k in range(1, levels):
        above = done.select("tree", F.col("node").alias("parent"), "block", "place", F.col("right").alias("_right"))
        done = nodes.filter(level == k).join(above, ["tree", "parent"])
        done = done.withColumn("place", 2 * F.col("place") + (F.col("node") == F.col("_right")).cast("int")).select(*found.columns)
        found = found.unionByName(done)
    index = lambda names: F.array_position(F.array(*[F.lit(c) for c in names]).cast("array<string>"), F.col("attr")).cast("int") - 1
    slot = F.struct(
        (F.col("kind") == LEAF).alias("leaf"), (F.col("kind") == CATEGORIC).alias("by_word"), F.when(F.col("kind") == CATEGORIC, index(categoric)).otherwise(index(numeric)).alias("x"),
        "split", "value", "left", "right", "n", "total", "counts")
    return found.groupBy("tree", "block").agg(F.map_from_entries(F.collect_list(F.struct("place", slot.alias("slot")))).alias("m")).select(
        "tree", "block", F.transform(F.sequence(F.lit(1), F.lit((1 << levels) - 1)), lambda i: F.try_element_at("m", i)).alias("slots"))


def _walk(levels: int) -> Column:
    """(place, out): where a row's walk through ``slots`` ends, and the node of another block that it goes on with, or -1."""
    start = F.struct(F.lit(1).alias("place"), F.lit(-1).alias("out"), F.lit(False).alias("stays"))

    def step(s: Column, _: Column) -> Column:
        n = F.get(F.col("slots"), s["place"] - 1)
        x, word = F.get(F.col("numbers"), n["x"]), F.get(F.col("words"), n["x"])
        missing = F.when(n["by_word"], word.isNull()).otherwise(x.isNull() | F.isnan(x))
        right = F.when(n["by_word"], word == n["value"]).otherwise(x > n["split"])
        place = 2 * s["place"] + right.cast("int")
        inside = place < 1 << levels
        stays = s["stays"] | n["leaf"] | missing
        moved = F.struct(F.when(inside, place).otherwise(s["place"]).alias("place"), F.when(inside, -1).otherwise(F.when(right, n["right"]).otherwise(n["left"])).alias("out"), (~inside).alias("stays"))
        return F.when(stays, F.struct(s["place"].alias("place"), s["out"].alias("out"), F.lit(True).alias("stays"))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step)


def ends(df: DataFrame, key: str, nodes: DataFrame, numeric: list[str], categoric: list[str], levels: int = LEVELS) -> DataFrame:
    """(key, tree, n, total, counts): of the node where each row's walk ends, in every tree. ``key`` tells rows apart."""
    spark = df.sparkSession
    blocks = written(node_blocks(nodes, numeric, categoric, levels), "blocks")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    roots = nodes.filter("depth = 1").select("tree", F.col("node").alias("block"))
    copies = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers, words = F.array(*[F.col(f"`{c}`").cast("double") for c in numeric]).cast("array<double>"), F.array(*[F.col(f"`{c}`").cast("string") for c in categoric]).cast("array<string>")
    rows = df.select(F.col(key), numbers.alias("numbers"), words.alias("words"))
    # a row meets each root: copies of the first blocks by number, rows dealt to a copy
    first = blocks.join(roots, ["tree", "block"], "left_semi").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    met = rows.withColumn("copy", F.pmod(F.xxhash64(F.col(key)), F.lit(copies)).cast("int")).join(first, "copy")
    parts = []
    for _ in range(0, deepest, levels):
        at = met.withColumn("at", _walk(levels)).withColumn("end", F.get("slots", F.col("at.place") - 1))
        step = written(at.select(F.col(key), "tree", "numbers", "words", F.col("at.out").alias("out"), F.when(F.col("at.out") < 0, F.struct("end.n", "end.total", "end.counts")).alias("end")), "routed")
        parts.append(step.filter("out < 0").select(F.col(key), "tree", "end.*"))
        met = step.filter("out >= 0").select(F.col(key), "tree", "numbers", "words", F.col("out").alias("block")).join(blocks, ["tree", "block"])
    if not parts:
        return df.select(F.col(key), F.lit(None).cast("int").alias("tree"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("array<double>").alias("counts")).filter("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predict_by_joins(df: DataFrame, key: str, nodes: DataFrame, numeric: list[str], categoric: list[str], classes: list[str] | None, levels: int = LEVELS) -> DataFrame:
    """(key, prediction) and, with classes, distribution: as ``predict`` of plans/forest.py, for a table of nodes of any size.
    Rows with the same key are taken for one; without trees there are no rows."""
    found = ends(df, key, nodes, numeric, categoric, levels)
    if classes is None:
        return found.groupBy(key).agg(F.avg(F.when(F.col("n") > 0, F.col("total") / F.col("n"))).alias("prediction"))
    sums = found.groupBy(key).agg(F.array(*[F.sum(F.coalesce(F.get("counts", F.lit(i)), F.lit(0.0))) for i in range(len(classes))]).alias("_c"))
    labels = F.array(*[F.lit(c) for c in classes])
    best = F.when(F.array_max("_c") > 0, F.element_at(labels, F.array_position("_c", F.array_max("_c")).cast("int")))
    return sums.select(key, best.alias("prediction"), F.map_from_arrays(labels, "_c").alias("distribution"))
