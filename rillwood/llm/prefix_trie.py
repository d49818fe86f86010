"""The trie of conversation prefixes.

A turn is the SHA-256 of its role and text; a prefix is the SHA-256 of the prefix before it and the turn, so equal prefixes
have equal digests and the chain holds 32 bytes of a conversation, whatever its length. Conversations are chained in sorted
streams, a row at a time. Every prefix of every conversation is a row; grouped by depth and digest these are the nodes.

Sums over subtrees send each node to all its ancestors. A node belongs to its smallest member, and the nodes of one member
lie on one path: what they send to the same ancestor is added up along the conversation before it is shuffled, so that a
conversation sends one row a prefix, not one a pair of prefixes, and the work is linear even in very long conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table

#: A conversation borrows turns from the one whose id is its own without the remainder by FAMILY; fewer than LENT turns.
FAMILY, LENT = 100, 6
#: Ids that end in one node are joined to texts by ranges of 2^CHUNK ids.
CHUNK = 12
_ROOT = hashlib.sha256(b"").digest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(c, k, turn, n_chars): each turn's digest and code points, and its place from 1 in its conversation."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("at"), digest.alias("turn"), F.length(text).cast("long").alias("n_chars"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("c").orderBy(F.asc_nulls_first("at"), "turn"))).drop("at")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, part, k, turn, n_chars) of every conversation rebuilt, in the order of part and k: part -1 is a row without a turn
    for each conversation, 0 what is lent, 1 its own rest."""
    turns = turn_digests(conversations)
    borrows = F.crc32(F.col("c").cast("string").cast("binary")) % LENT
    convs = turns.select("c").distinct().withColumn("h", borrows).withColumn("lender", F.col("c") - F.col("c") % FAMILY)
    lent = turns.filter((F.col("c") % FAMILY == 0) & (F.col("k") < LENT)).withColumnRenamed("c", "lender")
    lent = convs.join(lent, "lender").filter("k <= h")
    parts = (convs.select("c", F.lit(-1).alias("part"), F.lit(0).alias("k"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("n_chars")),
             lent.select("c", F.lit(0).alias("part"), "k", "turn", "n_chars"),
             turns.filter(F.col("k") > borrows).select("c", F.lit(1).alias("part"), "k", "turn", "n_chars"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PREFIX = pa.schema([("c", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_chars", pa.int64()), ("ends", pa.bool_())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix, of conversations that come one after another, each led by its row without a turn."""
    depth, node, held = 0, _ROOT, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PREFIX)], schema=_PREFIX)

    for batch in batches:
        rows = []
        for c, turn, n in zip(*(batch.column(x).to_pylist() for x in ("c", "turn", "n_chars"))):
            if held:
                rows.append((*held, turn is None))
            if turn is None:
                depth, node, held = 0, _ROOT, (c, 0, _ROOT, None, 0)
            else:
                before, depth, node = node, depth + 1, hashlib.sha256(node + turn).digest()
                held = (c, depth, node, before, n)
        yield out(rows)
    if held:
        yield out([(*held, True)])


def prefixes(conversations: DataFrame) -> DataFrame:
    """(c, depth, node, parent, n_chars, ends): every prefix of every rebuilt conversation, the empty one with them.

    Conversations are dealt by a hash of c, not by c: the parts may all lie by c already, then Spark leaves this shuffle out,
    and as it joins small partitions of each part by itself, a conversation's parts would meet in different tasks."""
    return rebuilt(conversations).repartition(F.xxhash64("c")).sortWithinPartitions("c", "part", "k").mapInArrow(_chain, "c long, depth long, node binary, parent binary, n_chars long, ends boolean")


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the texts of each node, joined by commas; a node's texts come one after another."""
    node, so_far = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        rows = []
        for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if at == node:
                so_far.update(b"," + ids.encode())
                continue
            if so_far:
                rows.append((node, so_far.hexdigest()))
            node, so_far = at, hashlib.sha256(ids.encode())
        yield out(rows)
    if so_far:
        yield out([(node, so_far.hexdigest())])


def ends_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes in which conversations end. Ids are joined to texts by ranges of ids, many tasks to a
    node; a node's texts are then hashed one after another and never held together."""
    chunks = rows.filter("ends").groupBy("node", F.shiftright("c", CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(_digest_runs, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Turns are ordered by turn, null first,
    those alike in turn by the SHA-256 of role and text; repeated rows are turns of their own. Null roles and texts are
    empty. Rows without a conv_id belong to no conversation. Of an empty table there are no nodes, the root included. A
    remainder has the sign of its id. Ids, turns and texts may be as many and as long as they like; one turn must fit a task.
    """
    rows = write_table(prefixes(conversations), "prefixes")
    grouped = rows.groupBy("depth", "node").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n_chars").alias("n_chars"))
    grouped = write_table(grouped, "nodes")
    children = grouped.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = write_table(grouped.join(children, ["depth", "node"], "left").fillna(0, ["n_children"]), "nodes")

    own = nodes.select(F.col("conv_id").alias("c"), "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    below = W.partitionBy("c").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sent = rows.select("c", "depth", "node").join(own, ["c", "depth"], "left").select("depth", "node", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved"))
    sums = sent.filter("leaf IS NOT NULL").groupBy("depth", "node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, ["depth", "node"]).join(ends_digests(rows), "node", "left").join(parents, ["depth", "parent"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
#: DuckDB: prefixes as lists of turns, each node joined to all prefixes of its first member.
TRIE_SQL = f"""
    WITH t AS (SELECT conv_id AS c, turn AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY place NULLS FIRST, x) AS k, x, n FROM (
        SELECT c, place, sha256(strlen(role) || ':' || role || text) AS x, length(text) AS n FROM t)),
    v AS (SELECT c, {_CRC} % {LENT} AS h FROM (SELECT DISTINCT c FROM t)),
    r AS (
        SELECT v.c, 0 AS part, k, x, n FROM v JOIN o ON o.c = v.c - v.c % {FAMILY} AND k <= h
        UNION ALL SELECT v.c, 1, k, x, n FROM v JOIN o ON o.c = v.c AND k > h),
    l AS (SELECT v.c, coalesce(x, []) AS x, coalesce(n, []) AS n FROM v LEFT JOIN (
        SELECT c, list(x ORDER BY part, k) AS x, list(n ORDER BY part, k) AS n FROM r GROUP BY c) AS g ON g.c = v.c),
    p AS (SELECT c, d AS depth, x[1:d] AS node, len(x) = d AS ends, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS n FROM (
        SELECT c, x, n, unnest(range(len(x) + 1)) AS d FROM l)),
    g AS (SELECT depth, node, min(c) AS c, count(*) AS n_convs, min(n) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY depth, node),
    m AS (SELECT g.*, coalesce(k, 0) AS n_children FROM g LEFT JOIN (
        SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS k FROM g WHERE depth > 0 GROUP BY ALL) AS f ON f.depth = g.depth AND f.node = g.node),
    s AS (SELECT a.depth, a.node, CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.n) AS BIGINT) AS saved_tokens
        FROM m AS b JOIN p AS a ON a.c = b.c AND a.depth <= b.depth GROUP BY a.depth, a.node)
    SELECT m.c AS conv_id, m.depth, u.c AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
    FROM m JOIN s ON s.depth = m.depth AND s.node = m.node LEFT JOIN m AS u ON u.depth = m.depth - 1 AND u.node = m.node[1:m.depth - 1]"""
