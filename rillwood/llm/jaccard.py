"""Exact Jaccard similarity of whole shingle sets, and a join that finds every pair of sets at 4/5 or more.

A set of n shingles that is similar to another shares at least 4/5 of its own with it, so in any one order of all shingles
its first n - ceil(4n/5) + 1 hold one that both have. Those are its prefix, and sets meet in the bucket of each prefix
shingle. Shingles that many documents have come last in the order, so buckets are small; which ones those are is counted
over all documents in a table of fixed size, and no pair depends on it. Bounds by size, place and a sketch of the whole set, none of which loses a similar
pair, leave few pairs of a bucket, and all of those are verified.

No task holds more than ``LIMIT`` rows of a bucket. With one more shingle in the prefix similar sets share one more of it, so
a bucket over the limit is cut by the next shingle of each set's longer prefix, ``LEVELS`` times. What is still too large, or
has few sets that aren't joined already, is cut into blocks, and each task has the rows of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Cells that shingles are counted in, by the low bits of their hashes, and cells of one part of the table.
CELLS, _PART = 1 << 24, 1 << 18
#: Rows of a bucket beyond which it is cut, and how often that is done by one more shingle.
LIMIT, LEVELS = 2_048, 2
#: Bits of the filter by which texts that no pair asks for are passed over.
FILTER = 1 << 22
_CHUNK = 1 << 16
_PAIRS = "a binary, b binary"
_NONE = np.empty(0, np.uint64)


def hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle in turn, some at a time; a text of fewer words is one shingle, one without none."""
    words = text.lower().split() if text else []
    n = max(1, len(words) - shingle + 1)
    shingle = min(shingle, len(words))
    for at in range(0, n if words else 0, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        yield np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(shingle)))], np.uint64)


def whole_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct hashes of all shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes(text, shingle)]))


def digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def ranked(members: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The members by (rank of the cell, hash)."""
    return members[np.argsort(ranks[(members & np.uint64(len(ranks) - 1)).astype(np.int64)], kind="stable")]


def prefix(members: np.ndarray, frequent: np.ndarray = _NONE, counts: np.ndarray = _NONE) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 members by (count of those listed, place), and ``LEVELS`` more. Sets of three or fewer are similar to
    equal ones only and need none."""
    n = len(members)
    if n < 4:
        return members[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        members = members[np.argsort(np.where(frequent[at] == members, counts[at], 0), kind="stable")]
    return members[: n - (4 * n + 4) // 5 + 1 + LEVELS]


def sketch(members: np.ndarray) -> bytes:
    """For each value of the low bits of the members whether an odd number of them has it; a bit a member or more, as far
    as 32768. Of two sets, at most as many bits differ as members are in one only."""
    m = 1 << min(15, max(8, len(members).bit_length()))
    return np.packbits(np.bincount((members & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def _folded(x: bytes, size: int) -> int:
    out = 0
    for k in range(0, len(x), size):
        out ^= int.from_bytes(x[k : k + size], "little")
    return out


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the size of the other."""
    size = min(len(x), len(y))
    return (_folded(x, size) ^ _folded(y, size)).bit_count()


def lists(of: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *of]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int32)), pa.array(flat))


def shingle_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """How frequent the shingles of each of ``CELLS`` cells are over all documents, as eighths of an octave in a byte. Each
    task counts its documents' shingles by cell; what is shuffled is its table, compressed, and what is sent out is a byte
    a cell, whatever the input. Only the order of prefixes comes from it, so cells that several shingles share lose no pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                held = [whole_set(t.as_py(), shingle) for t in b.column(0).slice(at, 256).cast(pa.large_binary())]
                where, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]) & np.uint64(CELLS - 1), return_counts=True)
                cells[where] += n.astype(np.uint32)
        for k, part in enumerate(cells.reshape(-1, _PART)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                more = np.frombuffer(pa.decompress(n, 4 * _PART, "zstd", asbytes=True), np.uint32)
                sums[k] = sums[k] + more if k in sums else more.astype(np.int64)
        for k, n in sums.items():
            ranks = np.minimum(255, 8 * np.log2(n + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([ranks.tobytes()], pa.binary())], names=["part", "n"])

    kinds, out = "part long, n binary", np.zeros((CELLS // _PART, _PART), np.uint8)
    for r in docs.select("text").mapInArrow(count, kinds).repartition("part").mapInArrow(add, kinds).collect():  # a byte a cell
        out[r["part"]] = np.frombuffer(bytes(r["n"]), np.uint8)
    return out.ravel()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(a, b): the pairs of digests whose whole sets have a Jaccard similarity of 4/5 or more; docs: (doc_id, text),
    nodes: (digest, first_id)."""
    either = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = write_table(either.join(nodes.select("digest", "first_id"), "digest"), "wanted")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    bits = np.zeros(FILTER, bool)
    bits[wanted.select(place("first_id").alias("k")).distinct().toArrow()["k"].to_numpy()] = True
    asked = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(asked.value).astype(bool)
        for b in batches:
            texts = b.column(0).filter(pa.array(have[b.column(1).to_numpy()]))
            for at in range(0, len(texts), 64):
                held = [whole_set(t.as_py(), shingle) for t in texts[at : at + 64].cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in held], pa.binary()), lists(held)], names=["digest", "members"])

    found = docs.select("text", place("doc_id").alias("k")).mapInArrow(run, "digest binary, members array<long>")
    held = write_table(found.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), "members")
    both = pairs.join(held.select(F.col("digest").alias("a"), F.col("members").alias("x")), "a").join(held.select(F.col("digest").alias("b"), F.col("members").alias("y")), "b")
    # both / (x + y - both) >= 4 / 5
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _bucketed(posts: DataFrame, limit: int | None) -> DataFrame:
    """(x, y, hot): the pairs of keys of the buckets of posts (token, n, pos, key, comp), and the tokens of buckets over the
    limit, of which no pair is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = np.empty((5, 0), np.int64), None  # rows of the last bucket so far; its token if it is over the limit
        for b in batches:
            rows = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "pos", "key", "comp")])
            if over is not None:
                rows = rows[:, rows[0] != over]
            rows = np.hstack([held, rows])
            if not rows.size:
                continue
            over, last = None, int(np.searchsorted(rows[0], rows[0, -1]))
            yield from _within(rows[:, :last], limit)
            held = rows[:, last:]
            if limit and held.shape[1] > limit:
                over = int(held[0, 0])
                yield _hot([over])
                held = held[:, :0]
        yield from _within(held, limit)

    return posts.select("token", "n", "pos", "key", "comp").repartition("token").sortWithinPartitions("token", "n", "key").mapInArrow(run, "x long, y long, hot long").distinct()


def _hot(tokens) -> pa.RecordBatch:
    t = pa.array(np.array(tokens, np.int64))
    return pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64()), t], names=["x", "y", "hot"])


def _within(rows: np.ndarray, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of whole buckets, and the tokens of those over the limit."""
    if limit and rows.size:
        tokens, sizes = np.unique(rows[0], return_counts=True)
        if (large := sizes > limit).any():
            yield _hot(tokens[large])
            rows = rows[:, ~np.isin(rows[0], tokens[large])]
    for pairs in _pairs(rows):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["x", "y", "hot"])


def bucket_pairs(rows: DataFrame, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """(x, y): pairs of keys of ``rows`` (key, comp, n, prefix), of which no similar one is missing but those of one comp."""
    own = F.expr("cast(n - (4 * n + 4) div 5 + 1 as int)")
    posts = rows.select("n", "key", "comp", F.posexplode(F.slice("prefix", F.lit(1), own)).alias("pos", "token"))
    found = None
    for level in range(levels + 1):
        out = write_table(_bucketed(posts, limit), "found")
        part = out.filter("hot IS NULL").select("x", "y")
        found = part if found is None else found.unionByName(part)
        hot = out.filter("hot IS NOT NULL").select(F.col("hot").alias("token"))
        if hot.isEmpty():
            break
        held = write_table(posts.join(hot, "token"), "hot")
        shape = held.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("big"), F.sum("c").alias("m"))
        # blocks of the largest comp, whose rows needn't meet, and of all others
        shape = shape.select("token", F.col("big.comp").alias("big"), F.ceil(F.col("big.c") * 2 / limit).alias("a"), F.ceil((F.col("m") - F.col("big.c")) * 2 / limit).alias("o")).filter("o > 0")
        shape = write_table(shape, "shape")
        now = F.lit(True) if level == levels else F.col("o") <= 4
        of_big = F.col("comp") == F.col("big")
        block = F.pmod(F.xxhash64("key"), F.when(of_big, F.col("a")).otherwise(F.col("o"))) + F.when(of_big, F.col("o")).otherwise(F.lit(0))
        met = F.when(of_big, F.sequence(F.lit(0).cast("long"), F.col("o") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("o") + F.col("a") - 1))
        cut = held.join(shape.filter(now), "token").withColumn("own", block).withColumn("other", F.explode(met))
        cut = cut.withColumn("token", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
        found = found.unionByName(write_table(_bucketed(cut, None).select("x", "y"), "found"))
        later = shape.filter(~now).select("token")
        if level == levels or later.isEmpty():
            break
        # the last shingle's place is pos + level; those after it, as far as a prefix that is level + 1 longer
        at = F.col("pos") + F.lit(level)
        longer = held.join(later, "token").select("token", "pos", "key").join(rows, "key")
        after = F.slice("prefix", at + 2, F.greatest(F.lit(0), own + F.lit(level) - at))
        posts = longer.select("n", "key", "comp", "token", "pos", F.posexplode(after).alias("i", "next"))
        posts = posts.select("n", "key", "comp", (F.col("pos") + F.col("i")).cast("int").alias("pos"), F.xxhash64("token", "next").alias("token"))
    return found.distinct()


def candidates(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """(a, b): pairs of digests of which no similar one is missing but those of one star of ``stars`` (node, least).
    nodes: (digest, n, prefix). Pairs of a bucket are told by hashes of digests, so one too many at worst is verified."""
    key = lambda c: F.xxhash64(c)
    joined = nodes.join(stars.select(F.col("node").alias("digest"), "least"), "digest", "left")
    found = bucket_pairs(joined.select(key("digest").alias("key"), key(F.coalesce("least", "digest")).alias("comp"), "n", "prefix"))
    keys = nodes.filter("n > 3").select(key("digest").alias("key"), "digest")
    return found.join(keys.toDF("x", "a"), "x").join(keys.toDF("y", "b"), "y").select("a", "b")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of digests (a, b) that sizes and sketches, which bound the members that are in one set only, don't rule
    out; nodes: (digest, n, sketch)."""
    end = lambda k, n, s: nodes.select(F.col("digest").alias(k), F.col("n").alias(n), F.col("sketch").alias(s))
    ends = pairs.join(end("a", "nx", "sx"), "a").join(end("b", "ny", "sy"), "b").filter("5 * least(nx, ny) >= 4 * greatest(nx, ny)").select("a", "b", F.col("nx") + F.col("ny"), "sx", "sy")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [9 * apart(x, y) <= n for n, x, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            kept = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    return ends.mapInArrow(near, _PAIRS)


def _pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the pairs in the buckets of rows (token, n, pos, key, comp), sorted, that can be similar and aren't joined yet.
    A pair's first shared prefix shingle passes the bound by place, so it is found in that bucket if in no other."""
    if not rows.size:
        return
    starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
    mixed = np.minimum.reduceat(rows[4], starts) != np.maximum.reduceat(rows[4], starts)
    rows = rows[:, np.repeat(mixed, np.diff(np.append(starts, rows.shape[1])))]
    token, n, pos, key, comp = rows
    at, gap, held, size = np.arange(len(token)), 1, [], 0
    while True:  # each row with the next one, the one after it and so on, while sizes allow
        at = at[at + gap < len(token)]
        at = at[(token[at] == token[at + gap]) & (5 * n[at] >= 4 * n[at + gap])]
        if len(at):
            to = at + gap
            ok = (comp[at] != comp[to]) & (9 * np.minimum(n[at] - pos[at], n[to] - pos[to]) >= 4 * (n[at] + n[to]))
            x, y = key[at[ok]], key[to[ok]]
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            size += len(x)
        if held and (not len(at) or size > 200_000):
            yield np.unique(np.concatenate(held), axis=0)
            held, size = [], 0
        if not len(at):
            return
        gap += 1
