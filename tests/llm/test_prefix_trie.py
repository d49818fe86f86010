"""The trie of conversation prefixes against one that is walked node by node."""

import hashlib
import random
import zlib

import duckdb

from rillwood.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c int, depth string, node string, k int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "d", "n", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    turns = {}
    for c, at, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append(((at is not None, at or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    children = {}
    for v in nodes:
        if v:
            children.setdefault(v[:-1], []).append(v)

    def subtree(v):
        yield v
        for x in children.get(v, []):
            yield from subtree(x)

    smallest = {v: min(c for c, _ in m) for v, m in nodes.items()}
    out = []
    for v, m in nodes.items():
        below = list(subtree(v))
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((smallest[v], len(v), smallest[v[:-1]] if v else None, len(m), len(children.get(v, [])), sum(x not in children for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def some(seed, convs, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for t in range(rng.choice([1, 2, 3, 9]))]
    rng.shuffle(rows)
    return rows


def test_many_small_ones(spark):
    rows = some(1, [*range(0, 260), *range(5000, 5040), -3, -100, -250], ["a", "bb", "é", "long text"])
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_chunks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    rows = [(c, t, "user", "same") for c in range(-90, 90) for t in range(8)]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_parts_of_conversations_meet(spark, monkeypatch):
    """All parts lie by c already, and small partitions are joined, fewer of turns than of bare ids: a conversation's parts
    still come to one task. Whether Spark plans the query so depends on which of its stages ends first; here it always does."""
    plain = prefix_trie.rebuilt

    def by_c(conversations):
        parts = [plain(conversations).filter(f"part = {k}").repartition("c") for k in (-1, 0, 1)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    monkeypatch.setattr(prefix_trie, "rebuilt", by_c)
    kept = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    rows = some(2, range(1000), ["a", "bb", "é", "long text"])
    df = table(spark, rows)
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        assert found(prefix_trie.prefix_trie(df)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    """Nulls in any column, turns alike, repeated rows, a conversation without any turn left, no lender."""
    rows = [(0, None, None, None), (0, 0, "user", ""), (0, 0, "user", "x"), (0, 0, "user", "x"), (None, 0, "user", "x"), (1, 5, "", "userx"), (1, 6, None, "a:b"), (2, 1, "user", "only"), (777, 0, "user", "alone"), (778, 3, "u", "ser"), (778, None, "use", "r")]
    assert found(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)
    assert found(prefix_trie.prefix_trie(table(spark, rows[9:]))) == brute(rows[9:])
    assert found(prefix_trie.prefix_trie(table(spark, []))) == []


def test_a_very_long_conversation_and_a_long_text(spark):
    """20,000 turns that another shares: pairs of nodes and ancestors would be 200 million."""
    rows = [(c, t, "user", f"turn {t}" if t % 7 else "again") for c in (0, 100) for t in range(20_000)] + [(100, 30_000, "user", "y" * 3_000_000)]
    got = {(r.depth, r.conv_id): r for r in prefix_trie.prefix_trie(table(spark, rows)).collect()}
    h = zlib.crc32(b"100") % 6  # 100 lends to itself
    assert h >= 0 and len(got) == 20_002
    root = got[0, 0]
    assert (root.n_convs, root.n_children, root.n_leaves) == (2, 1, 1)
    assert root.saved_tokens == sum(len(f"turn {t}" if t % 7 else "again") for t in range(20_000))
    assert got[20_001, 100].parent_conv_id == 0 and got[20_000, 0].n_children == 1


def test_query_and_sql_agree(spark, sf_dir):
    got = prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = duckdb.sql(prefix_trie.TRIE_SQL)
    assert want.columns == got.columns
    assert found(got) == sorted(want.fetchall(), key=str)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
