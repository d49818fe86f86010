"""SimHash: fingerprints, links and components against brute force, and the odd rows."""

import random

import pytest
import xxhash

from rillwood.llm import simhash


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=4):
    fps = {i: f for i, f in rows}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "  \t\n", "One", "a B c", "a b c d", "a b c d e f g a b c d", "É é x\x0by z", "w " * 5000])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(None if text is None else text.encode())) == brute_fingerprint(text)


@pytest.mark.parametrize(("limit", "refinements", "rows_planned"), [(20_000, 2, 1), (20_000, 2, 10**9), (20_000, 2, 10**13), (3, 2, 1), (3, 0, 1)])
def test_links_lose_nothing(spark, limit, refinements, rows_planned):
    rng, fps = random.Random(3), []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 25])):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    rows = list(enumerate(fps))
    want = brute_components(rows)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    plan = simhash.Plan.exact(4, rows_planned)
    assert len(plan.tables) == {1: 5, 10**9: 15, 10**13: 35}[rows_planned]
    edges = simhash.link_fingerprints(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), plan, limit, refinements)
    got = {r.node: r.least for r in simhash.components(edges).collect()}
    by = {signed(f): i for i, f in enumerate(fps)}
    groups: dict = {}
    for s, i in by.items():
        groups.setdefault(got.get(s, s), set()).add(i)
    wanted: dict = {}
    for i, r in want.items():
        wanted.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = simhash.near_groups(docs).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(i, f, want[i]) for i, f in rows}
    assert all(len(r.fingerprint) == 16 for r in got)


def by_text(rows):
    return sorted(rows, key=str)


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    rows = [(5, None, "x", 1), (3, "", "x", 1), (None, " ", "x", 1), (9, "same words here now", "x", 1), (9, "same words here now", "x", 1), (None, "alone in all this", "x", 1)]
    got = by_text((str(r.doc_id), r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == by_text([("5", 3), ("3", 3), ("None", 3), ("9", 9), ("9", 9), ("None", None)])
    assert simhash.near_groups(spark.createDataFrame([], schema)).count() == 0


def test_near_copies_go(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:20]):
        edited = list(w)
        for k in rng.sample(range(300), 4):  # about 0.88 of the five-word shingles stay
            edited[k] = "changed"
        rows.append((100 + i, " ".join(edited)))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(40)) <= kept
    assert len(kept) <= 41
