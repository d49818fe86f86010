"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, by blocks: a block of queries of bounded size is broadcast, each task multiplies it
with the vectors it reads. No score is kept. A first pass counts, for each query, how many scores fall into each of 2,048
equal bins of the range that the lengths of vectors allow; the counts of all tasks add up, and the bin that holds the k-th
highest score becomes the next pass's range, until a bin is one score wide. The last pass gives back what scores at least
the k-th value, and ties there go to the smallest ids. A task sends no bin under its own k-th score, and no tie beyond its
own k first: neither can be among the k highest of all rows.

Scores are inner products of the components floor(1024 * x). They are exact integers: in doubles where the lengths of the
vectors prove that no sum can pass 2^53, else in whole numbers of any size; a score beyond a long counts as the nearest long.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import work_dir, write_table

#: Of a histogram: bins for each query, as a power of two. Of a block of queries: bytes and rows at most. Scores at a time.
BITS, BLOCK_BYTES, BLOCK_ROWS, CELLS = 11, 4 << 20, 2048, 1 << 20
SCALE = 1024
#: Doubles hold every integer as far as this; half of it, so that rounded lengths prove it.
EXACT = 2.0**52
_LOWEST = -(1 << 63)
_RESULT = "query_id long, rank int, vec_id long, score long"


def usable_vectors(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v): the vectors without null or non-finite components, and a number of its own for each row."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.filter(F.col(vector).isNotNull() & ~bad).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Integral components as doubles, cut or filled with zeros to ``width``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.asarray(vectors.flatten(), np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * SCALE), -np.finfo(np.float64).max, np.finfo(np.float64).max)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[np.repeat(np.arange(len(lengths)), lengths)[inside], place[inside]] = flat[inside]
    return out


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(axis=1))


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integral rows as int64, exact or the nearest long."""
    if not len(rows) or not len(queries):
        return np.zeros((len(queries), len(rows)), np.int64)
    if _lengths(queries).max() * _lengths(rows).max() <= EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [[[int(x) for x in r] for r in m] for m in (queries, rows)]
    return np.array([[max(_LOWEST, min(-_LOWEST - 1, sum(map(int.__mul__, q, r)))) for r in whole[1]] for q in whole[0]], np.int64)


class _Block:
    """Queries as a matrix in the order of their rows."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r.row)
        self.row = np.array([r.row for r in rows], np.int64)
        self.id = [r.vec_id for r in rows]
        self.width = max(len(r.v) for r in rows)
        self.matrix = _matrix(pa.array([r.v for r in rows], pa.list_(pa.float64())), self.width)

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
        """Of some rows at a time: scores, whether a row is a candidate of each query, ids and rows."""
        step = max(1, CELLS // len(self.row))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                row = b.column("row").to_numpy()
                candidate = np.ones((len(self.row), len(row)), bool)
                own = np.minimum(np.searchsorted(self.row, row), len(self.row) - 1)
                found = np.flatnonzero(self.row[own] == row)
                candidate[own[found], found] = False
                yield exact_scores(self.matrix, _matrix(b.column("v"), self.width)), candidate, b.column("vec_id"), row


def _counter(block, low: np.ndarray, need: np.ndarray, shift: int, bins: int) -> Callable:
    """Counts of the scores in ``bins`` bins of 2^shift from each query's ``low``, from the top to the bin that has a task's
    own ``need``-th."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        n, base = len(b.row), low.view(np.uint64)[:, None]
        counts = np.zeros(n * bins, np.int64)
        first = (np.arange(n, dtype=np.int64) * bins)[:, None]
        for score, candidate, _, _ in b.scores(batches):
            place = (score.view(np.uint64) - base) >> np.uint64(shift)
            inside = candidate & (score >= low[:, None]) & (place < np.uint64(bins))
            counts += np.bincount((first + place.view(np.int64))[inside], minlength=n * bins)
        top = counts.reshape(n, bins)[:, ::-1]
        above = np.cumsum(top, axis=1) - top
        query, at = np.nonzero((top > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bins - 1 - at), pa.array(top[query, at]), pa.array(need[query])], names=["q", "bin", "n", "need"])

    return count


def _first(q: np.ndarray, score: np.ndarray, unknown: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's first k in the order of the result."""
    order = np.lexsort((row, vec_id, unknown, np.invert(score), q))  # ~x falls as x rises, without overflow
    q = q[order]
    starts = np.searchsorted(q, q)
    return order[np.arange(len(q)) - starts < k]


def _taker(block, low: np.ndarray, k: int) -> Callable:
    """What scores at least ``low``, of each query the task's first k."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for score, candidate, ids, row in b.scores(batches):
            query, at = np.nonzero(candidate & (score >= low[:, None]))
            if len(query):
                unknown, vec_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                held = [np.concatenate(x) for x in zip(held, (query, score[query, at], unknown[at], vec_id[at], row[at]))]
                keep = _first(*held, k)
                held = [x[keep] for x in held]
        query, score, unknown, vec_id, row = held
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array([b.id[x] for x in query], pa.int64()), pa.array(vec_id, mask=unknown), pa.array(score), pa.array(row)], names=["q", "query_id", "vec_id", "score", "row"])

    return take


def _kth_scores(rows: DataFrame, block, k: int, longest: float) -> np.ndarray:
    """Each query's k-th highest score, the lowest long where there are fewer candidates than k."""
    b = block.value
    n, most = len(b.row), float(_lengths(b.matrix).max()) * longest
    bits = 63 if not most < 2.0**62 else max(1, math.ceil(math.log2(most + 2)))
    low, need, few = np.full(n, -(1 << bits), np.int64), np.full(n, k, np.int64), np.ones(n, bool)
    shift, left = max(0, bits + 1 - BITS), bits + 1
    w = W.partitionBy("q").orderBy(F.desc("bin"))
    while True:
        counted = rows.mapInArrow(_counter(block, low, need, shift, 1 << (left - shift)), "q long, bin long, n long, need long")
        summed = counted.groupBy("q", "bin").agg(F.sum("n").alias("n"), F.first("need").alias("need")).withColumn("above", F.sum("n").over(w) - F.col("n"))
        found = summed.filter("above < need AND above + n >= need").select("q", "bin", "above").collect()  # a row a query of the block
        if left == bits + 1:
            few[[r.q for r in found]] = False
        for r in found:
            low[r.q] = int(low[r.q]) + (r.bin << shift)
            need[r.q] -= r.above
        if not shift:
            break
        shift, left = max(0, shift - BITS), shift
        need[few] = 0
    low[few] = _LOWEST
    return low


def top_k(embeddings: DataFrame, is_query: Column | None = None, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row for which ``is_query`` (an expression
    of ``vec_id``; by default ids divisible by 100) with every row but itself, all if there are fewer, ties to smaller ids.

    Vectors that are null or have a null or non-finite component take no part, neither as queries nor as candidates. An empty
    vector scores 0; where lengths differ, missing components count as 0. Rows that share an id are rows of their own: each is
    a query, each a candidate, in any order among themselves where their scores are alike. A null id is no query; as a
    candidate it comes last among ties. Of an empty table, or one without queries, the result is empty; other columns are
    ignored. The longest vector must fit a task.
    """
    spark = embeddings.sparkSession
    rows = write_table(usable_vectors(embeddings, vec_id, vector), "vectors")
    queries = rows.filter(F.col("vec_id") % 100 == 0 if is_query is None else is_query)
    facts = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("squares"), F.max(F.size("v")).alias("width")).first()
    n, bytes_a_query = queries.count(), 8 * max(1, facts.width or 0)
    if not n:
        return spark.createDataFrame([], _RESULT)
    held = 1 << int(math.log2(max(1, min(BLOCK_ROWS, BLOCK_BYTES // bytes_a_query))))  # a power of two, so that no block has two partitions
    queries = write_table(queries.repartition(math.ceil(n / held)).withColumn("block", F.shiftright(F.monotonically_increasing_id(), held.bit_length() - 1)), "queries")
    longest = SCALE * math.sqrt(facts.squares) + math.sqrt(facts.width) + 1
    path, w = f"{work_dir(spark)}/top-{uuid.uuid4().hex}", W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    for at in sorted(r.block for r in queries.select("block").distinct().collect()):
        block = spark.sparkContext.broadcast(_Block(queries.filter(F.col("block") == at).select("row", "vec_id", "v").collect()))  # at most BLOCK_BYTES
        kth = _kth_scores(rows, block, k, longest)
        taken = rows.mapInArrow(_taker(block, kth, k), "q long, query_id long, vec_id long, score long, row long")
        taken.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        block.unpersist()
    return spark.read.schema(_RESULT).parquet(path)


#: DuckDB: the same by a join of the queries with all rows.
TOP_SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10"""
