"""SimHash near-duplicates by BK-trees.

Distinct fingerprints go to shards, a BK-tree is built in each (children keyed by whole Hamming distance to their parent)
and every fingerprint of the shard searches it, following only edges within the radius of its distance to a node. Links
found become a spanning star for each group of a shard, and stars are joined to components by alternating large and small
stars.

Sharding loses no link. 64 bits are cut into radius + j blocks, so two fingerprints within the radius agree in at least j of
them; every choice of j blocks is a table, and a shard is the fingerprints with the same bits in the blocks of a table. j
grows with the number of fingerprints, so that a shard has a tree of a useful size whatever the input.
A shard over ``SHARD_LIMIT`` is cut again: its fingerprints differ in the other bits only, of which radius + 1 blocks are
made, and again two within the radius agree in one. A shard that is still too large after ``REFINEMENTS`` such cuts becomes
several trees of bounded size, which are broadcast in bounded waves to the fingerprints of that shard.

Wider fingerprints (``lanes`` of 64 bits) estimate the similarity of whole shingle sets well enough for a threshold of
0.8. Their radius is too large for blocks to agree for certain, so their tables are sets of bits drawn once, and
``Plan.sampled`` says how likely a pair is to meet in one of them.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .jaccard import candidates, digest, hashes, lists, possible, prefix, ranked, shingle_ranks, sketch, verified, whole_set

#: Fingerprints of a shard beyond which it is cut again, and how often that is tried.
SHARD_LIMIT, REFINEMENTS = 20_000, 2
#: Fingerprints of an average shard beyond which its key takes one more block of bits.
SHARD_MEAN = 4_096
#: Fingerprints in the trees of one broadcast wave (16 bytes each).
WAVE = 400_000


def _lane_keys(lanes: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh64_intdigest(f"lane {k}", 42) | 1) for k in range(1, lanes)]


def fingerprint(text: bytes | None, shingle: int = 4, lanes: int = 1) -> bytes:
    """64 bits a lane, each set if it is set in over half the hashes of the shingles, repeats included; bytes in order of
    value. Hashes of the first lane are XXH64 (seed 42); the others spread those anew."""
    return fingerprint_of(hashes(text, shingle), lanes)


def fingerprint_of(parts: Iterable[np.ndarray], lanes: int) -> bytes:
    """The fingerprint of the hashes in ``parts``, each counted as often as it is there."""
    n, total, keys = 0, np.zeros((lanes, 64), np.int64), _lane_keys(lanes)
    for h in parts:
        n += len(h)
        for k in range(lanes):
            if k:
                h = (h ^ (h >> np.uint64(29))) * keys[k - 1]
                h ^= h >> np.uint64(32)
            total[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, axis=1, bitorder="little").view(np.uint64).astype(">u8").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, lanes) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), column(matrix(pa.array(fps, pa.binary())))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, fp {sql_type(lanes)}")


def sql_type(lanes: int) -> str:
    """Fingerprints of one lane are numbers, by which joins and sums are hashed in place."""
    return "long" if lanes == 1 else "binary"


def matrix(fps: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of fingerprints as a (rows, lanes) array of unsigned 64-bit numbers."""
    if pa.types.is_int64(fps.type):
        return fps.to_numpy().view(np.uint64).reshape(-1, 1)
    raw = fps.to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)


def column(fps: np.ndarray) -> pa.Array:
    if fps.shape[1] == 1:
        return pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64))
    raw, size = np.ascontiguousarray(fps).astype(">u8").tobytes(), 8 * fps.shape[1]
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[-1] == 1:
        return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64)
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees of several groups of distinct fingerprints at once; ``root`` has each row's tree (the row of its root)."""

    def __init__(self, fps: np.ndarray, root: np.ndarray):
        self.fps, self.root = fps, root
        n, most = len(fps), 64 * fps.shape[1] + 1
        parents, edges, nodes = [], [], []
        rows = np.flatnonzero(root != np.arange(n))
        at = root[rows]
        while len(rows):  # all rows descend one level at a time; the first at a free edge becomes the child there
            d = distance(fps[rows], fps[at])
            key, first, where = np.unique(at * most + d, return_index=True, return_inverse=True)
            parents.append(key // most)
            edges.append(key % most)
            nodes.append(rows[first])
            stay = np.ones(len(rows), bool)
            stay[first] = False
            at, rows = rows[first][where[stay]], rows[stay]
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        order = np.argsort(parent, kind="stable")
        self.child = np.concatenate(nodes)[order] if nodes else np.empty(0, np.int64)
        self.edge = np.concatenate(edges)[order] if edges else np.empty(0, np.int64)
        self.count = np.bincount(parent, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if n else np.empty(0, np.int64)

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) rows within the radius, some at a time."""
        for lo in range(0, len(queries), 4096):
            todo = [(np.arange(lo, min(lo + 4096, len(queries))), roots[lo : lo + 4096])]
            while todo:
                q, node = todo.pop()
                d = distance(queries[q], self.fps[node])
                if (near := d <= radius).any():
                    yield q[near], node[near]
                n = self.count[node]
                if not (total := int(n.sum())):
                    continue
                own = np.repeat(np.arange(len(q)), n)
                ix = np.repeat(self.start[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                ok = np.abs(self.edge[ix] - d[own]) <= radius  # the only edges that can lead to a match
                q, node = q[own[ok]], self.child[ix[ok]]
                todo += [(q[i : i + 400_000], node[i : i + 400_000]) for i in range(0, len(q), 400_000)]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of rows a and b in ``label``, where each row has the least row of its group."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def shard_links(key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, first fingerprint of its group) for rows sorted by (key, fingerprint), without those that are alone."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    root = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    held = np.bincount(root, minlength=len(key))[root] > 1
    if not held.any():
        return fps[:0], fps[:0]
    fps, root = fps[held], (np.cumsum(held) - 1)[root[held]]
    label = np.arange(len(fps))
    for q, node in BKForest(fps, root).search(fps, root, radius):
        _join(label, q, node)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def shard_nearest(key: np.ndarray, fps: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, another of its group): the ``most`` nearest ones within the radius for rows sorted by key."""
    first = np.concatenate([[True], key[1:] != key[:-1]])
    root = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    held = np.bincount(root, minlength=len(key))[root] > 1
    if not held.any():
        return fps[:0], fps[:0]
    fps, root = fps[held], (np.cumsum(held) - 1)[root[held]]
    kept = np.empty((3, 0), np.int64)
    for q, node in BKForest(fps, root).search(fps, root, radius):
        other = q != node
        q, node = q[other], node[other]
        kept = np.hstack([kept, np.stack([q, distance(fps[q], fps[node]), node])])
        kept = kept[:, np.lexsort((kept[2] ^ kept[0], kept[1], kept[0]))]  # of equally near ones not the same for all
        start = np.concatenate([[True], kept[0, 1:] != kept[0, :-1]])[: kept.shape[1]]
        place = np.arange(kept.shape[1]) - np.maximum.accumulate(np.where(start, np.arange(kept.shape[1]), 0))
        kept = kept[:, place < most]
    a, b = np.unique(np.sort(kept[[0, 2]], axis=0), axis=1) if kept.size else kept[:2]
    return fps[a], fps[b]


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits, dtype=int), parts)]


@dataclass(frozen=True)
class Plan:
    """How fingerprints go to shards: the bits of each table, and into how many blocks a further cut makes of the rest
    (0: none is made). Links join groups of a shard in stars, or, with ``nearest``, each fingerprint to so many nearest ones."""

    lanes: int
    radius: int
    tables: tuple[tuple[int, ...], ...]
    cuts: int
    nearest: int = 0

    @classmethod
    def exact(cls, radius: int, rows: int = 0) -> Plan:
        """64 bits; no pair within the radius is lost. The more rows, the more blocks are in a shard's key."""
        for take in range(1, 4):
            blocks = _cut(list(range(64)), radius + take)
            tables = tuple(tuple(sorted(sum(c, []))) for c in combinations(blocks, take))
            if rows <= SHARD_MEAN << min(map(len, tables)):
                break
        return cls(1, radius, tables, radius + 1)

    @classmethod
    def sampled(cls, lanes: int, radius: int, tables: int, bits: int, seed: int = 11) -> Plan:
        """``tables`` draws of ``bits`` bits: a pair with a share p of its bits apart meets with probability
        1 - (1 - (1 - p) ** bits) ** tables."""
        rng = random.Random(seed)
        return cls(lanes, radius, tuple(tuple(sorted(rng.sample(range(64 * lanes), bits))) for _ in range(tables)), 0, 2)

    def bits(self, path: tuple[int, ...]) -> list[int]:
        have = list(self.tables[path[0]])
        for p in path[1:]:
            have += _cut([b for b in range(64 * self.lanes) if b not in have], self.cuts)[p]
        return have

    def key(self, fps: np.ndarray, path: tuple[int, ...]) -> np.ndarray:
        """64 bits from the path and the fingerprints' bits that it names."""
        x, bits = np.full(len(fps), xxhash.xxh64_intdigest(repr(path), 1), np.uint64), self.bits(path)
        with np.errstate(over="ignore"):
            for k in range(self.lanes):
                x = (x ^ (fps[:, k] & np.uint64(sum(1 << (b - 64 * k) for b in bits if b // 64 == k)))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def _sharded(rows: DataFrame, plan: Plan, refined: bool) -> DataFrame:
    """(path, key, fp): the shards of (fp) rows, or of (path, fp) rows that are to be cut once more. ``path`` names the
    bits that agree: the table first, then the block of each further cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            for old in t["path"].unique().to_pylist() if refined else [None]:
                own = t["fp"].filter(pc.equal(t["path"], old)) if refined else t["fp"]
                fps, own = matrix(own), own.combine_chunks()
                top = tuple(map(int, old.split("."))) if refined else ()
                for k in range(plan.cuts if refined else len(plan.tables)):
                    path = (*top, k)
                    name = pa.array([".".join(map(str, path))] * len(fps), pa.string())
                    yield pa.RecordBatch.from_arrays([name, pa.array(plan.key(fps, path)), own], names=["path", "key", "fp"])

    return rows.mapInArrow(run, f"path string, key long, fp {sql_type(plan.lanes)}")


def _linked(shards: DataFrame, plan: Plan, limit: int) -> DataFrame:
    """(a, b, path, key): a link for each fingerprint of a group but its least, and the fingerprints a of shards over the
    limit, with b null. Rows come sorted by shard, so a task holds one batch and one shard of the limit at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None  # rows of the last shard so far; its key if rows of it were over the limit before
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            key = t["key"].to_numpy()
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:  # shards before the last one are whole
                yield from _links_of(t.slice(0, last), plan, limit, over)
                over = None
            held = t.slice(last)
            if len(held) > limit:
                over = int(key[-1])
                yield from _links_of(held, plan, limit, over)
                held = None
        if held is not None:
            yield from _links_of(held, plan, limit, over)

    ordered = shards.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(run, "a {0}, b {0}, path string, key long".format(sql_type(plan.lanes)))


def _links_of(t: pa.Table, plan: Plan, limit: int, over: int | None) -> Iterator[pa.RecordBatch]:
    """Links of the shards of sorted rows; those over the limit, and what follows of the one named ``over``, are left."""
    names = ["a", "b", "path", "key"]
    key = t["key"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    large = sizes > limit
    if over is not None:
        large |= key[starts] == over
    large = np.repeat(large, sizes)
    if large.any():
        left = t.filter(pa.array(large)).combine_chunks()
        for b in left.to_batches():
            yield pa.RecordBatch.from_arrays([b["fp"], pa.nulls(len(b), b["fp"].type), b["path"], b["key"]], names=names)
    if not large.all():
        own = key[~large], matrix(t["fp"].filter(pa.array(~large)))
        a, b = shard_nearest(*own, plan.radius, plan.nearest) if plan.nearest else shard_links(*own, plan.radius)
        yield pa.RecordBatch.from_arrays([column(a), column(b), pa.nulls(len(a), pa.string()), pa.nulls(len(a), pa.int64())], names=names)


def _by_broadcast(rest: DataFrame, lanes: int, radius: int) -> DataFrame:
    """(a, b): links within shards that cuts don't make small enough; rest: (path, key, fp). Waves of trees of bounded size
    are broadcast, and each fingerprint searches those of its own shards."""
    spark = rest.sparkSession
    n_waves, schema = rest.count() // WAVE + 1, "a {0}, b {0}".format(sql_type(lanes))
    found = None
    for w in range(n_waves):
        part = rest.filter(F.pmod(F.xxhash64("path", "key", "fp"), F.lit(n_waves)) == w).select("key", "fp").distinct().orderBy("key", "fp")
        keys, fps = [], []
        for r in part.toLocalIterator():
            keys.append(r[0])
            fps.append(r[1] if lanes == 1 else bytes(r[1]))
        if not keys:
            continue
        key = np.array(keys, np.int64)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        root = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        trees = spark.sparkContext.broadcast((BKForest(matrix(pa.array(fps, pa.int64() if lanes == 1 else pa.binary())), root), dict(zip(key[first].tolist(), np.flatnonzero(first).tolist(), strict=True))))

        def run(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            forest, roots = trees.value
            for b in batches:
                key, fps = b.column(0).to_numpy(), matrix(b.column(1))
                at = np.array([roots.get(k, -1) for k in key.tolist()], np.int64)
                own, at = fps[at >= 0], at[at >= 0]
                for q, node in forest.search(own, at, radius):
                    least = np.full(len(own), len(forest.fps), np.int64)  # the first node of the tree that a query finds
                    np.minimum.at(least, q, node)
                    nodes = np.unique(np.stack([node, least[q]], 1), axis=0)
                    queries = np.unique(q)
                    x = np.concatenate([forest.fps[nodes[:, 0]], own[queries]])
                    y = np.concatenate([forest.fps[nodes[:, 1]], forest.fps[least[queries]]])
                    apart = (x != y).any(axis=1)
                    yield pa.RecordBatch.from_arrays([column(x[apart]), column(y[apart])], names=["a", "b"])

        links = write_table(rest.select("key", "fp").mapInArrow(run, schema).distinct(), "wave")
        trees.unpersist()
        found = links if found is None else found.unionByName(links)
    return found if found is not None else spark.createDataFrame([], schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each node of (a, b) can reach, by alternating large and small stars; every node
    of an edge is there. Sums are partial first and written out before they are joined, so both sides of a join are
    shuffles alone and the rows of a hub can be split."""
    small = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    small = write_table(small, "edges")
    while True:
        roles = small.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(small.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        roles = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if roles.filter("up + down > 1 AND up > 0").isEmpty():  # all are stars: no node has two links up, or one up and one down
            return small.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = write_table(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large")
        low = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        star = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = write_table(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


def named_components(nodes: DataFrame, reach: DataFrame, key: str) -> DataFrame:
    """(key, component_id) of all ``nodes`` (key, first_id): the least first_id of the component; reach: (node, least)."""
    named = write_table(nodes.select(key, "first_id").join(reach.withColumnRenamed("node", key), key), "reached")
    ids = write_table(named.groupBy("least").agg(F.min("first_id").alias("component_id")), "ids")
    linked = named.join(ids, "least").select(key, "component_id")
    return write_table(nodes.select(key, "first_id").join(linked, key, "left").select(key, F.coalesce("component_id", "first_id").alias("component_id")), "named")


def link_fingerprints(fps: DataFrame, plan: Plan, limit: int = SHARD_LIMIT, refinements: int = REFINEMENTS) -> DataFrame:
    """(a, b): links that join the distinct fingerprints of (fp) that chains of steps within the radius join."""
    found, rest = [], _sharded(fps.select("fp"), plan, False)
    refinements = refinements if plan.cuts else 0
    for k in range(refinements + 1):
        out = write_table(_linked(rest, plan, limit), "links")
        found.append(out.filter("b IS NOT NULL").select("a", "b"))
        left = out.filter("b IS NULL").select("path", "key", F.col("a").alias("fp"))
        if left.isEmpty():
            break
        if k == refinements:
            found.append(_by_broadcast(write_table(left, "large"), plan.lanes, plan.radius))
        else:
            rest = _sharded(left.select("path", "fp"), plan, True)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, plan: Plan | None = None, limit: int = SHARD_LIMIT, refinements: int = REFINEMENTS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``: the fingerprint in hex digits and the smallest id
    that chains of links reach, itself included. Default plan: 64 bits, 4 or fewer apart.

    Equal fingerprints are one node, whatever their number. Null and blank texts have fingerprint zero and link like any
    other; repeated ids keep their rows; null ids never name a component unless all ids of it are null. An empty table
    gives an empty result. Other columns aren't read.
    """
    found = write_table(fingerprints(docs, id_col, text_col, shingle, plan.lanes if plan else 1), "fingerprints")
    nodes = write_table(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    plan = plan or Plan.exact(4, nodes.count())
    # what is joined last is written first, so that a fingerprint of very many rows is split
    every = named_components(nodes, components(link_fingerprints(nodes, plan, limit, refinements)), "fp")
    out = found.join(every, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16 * plan.lanes, "0").alias("fingerprint"), "component_id")


#: Likely groups for whole sets of five-word shingles at a similarity of 0.8 or more: 256 bits, of which pairs just that
#: similar differ in 39 on average (arccos(2s / (1 + s)) / pi of the bits for similarity s) and in 50 or fewer nearly always;
#: those mostly meet in one of 56 tables of 16 bits. What this misses, the join of prefixes finds.
SIMILAR = Plan.sampled(4, 50, 56, 16)


def shingle_sets(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(doc_id, digest, fp, n, prefix, sketch) of the whole set of shingles of each text of (doc_id, text), with a fingerprint in
    which a repeated shingle counts once."""
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [whole_set(t.as_py(), shingle) for t in b.column(1).cast(pa.large_binary())]
            fps, heads = [fingerprint_of([x], lanes) for x in sets], lists([prefix(ranked(x, ranks.value)) for x in sets])
            columns = [b.column(0), pa.array(map(digest, sets), pa.binary()), pa.array(fps, pa.binary()), pa.array(map(len, sets), pa.int64()), heads, pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "fp", "n", "prefix", "sketch"])

    return docs.mapInArrow(run, "doc_id long, digest binary, fp binary, n long, prefix array<long>, sketch binary")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, plan: Plan = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; of rows alike in the id all
    stay or go together. Rows with a null id stay.

    A group is what chains of pairs join whose whole sets of shingles have a Jaccard similarity of 0.8 or more. BK-trees give
    each fingerprint its nearest ones, which are verified first; then a join that misses no pair gives the pairs that those
    links don't join, which are verified too. Texts without words are one group.
    """
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = write_table(shingle_sets(texts, shingle, plan.lanes), "sets")
    nodes = write_table(found.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "nodes")
    reps = write_table(nodes.groupBy("fp").agg(F.min("digest").alias("rep")), "reps")
    near = link_fingerprints(reps, plan).distinct()
    near = near.join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    near = near.unionByName(nodes.join(reps, "fp").filter("digest <> rep").select(F.col("digest").alias("a"), F.col("rep").alias("b")))
    stars = write_table(components(verified(write_table(possible(near, nodes), "near"), texts, nodes, shingle)), "stars")
    more = write_table(possible(candidates(nodes, stars), nodes), "candidates")
    links = stars.toDF("a", "b").unionByName(verified(more, texts, nodes, shingle))
    every = named_components(nodes, components(links), "digest")
    gone = write_table(found.join(every, "digest").filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")
