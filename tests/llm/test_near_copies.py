"""The near-copy stage against brute force: groups of Jaccard similarity 0.8 or more of whole sets of five-word shingles."""

import random

import numpy as np
import pytest

from rillwood.llm import jaccard, simhash


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept_by_brute_force(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i for i in sets if root(i) == i}


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept(spark, rows):
    return {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_links_are_verified(spark):
    rng, rows = random.Random(7), []
    line = " ".join(words(rng, 9))
    for i in range(20):  # different texts with one line many times
        rows.append((i, "\n".join([" ".join(words(rng, 200)), *[line] * 20])))
    for i in range(40):  # about 0.6 to 0.79, which is near in bits
        base = words(rng, 200)
        edited = list(base)
        for k in range(5 + i % 5):
            edited[10 + 20 * k] = f"edit{i}"
        rows += [(100 + 2 * i, " ".join(base)), (101 + 2 * i, " ".join(edited))]
    want = kept_by_brute_force(rows)
    assert len(want) == len(rows)
    assert kept(spark, rows) == want


def test_a_line_repeated_in_one_copy(spark):
    rng, rows = random.Random(9), []
    for i in range(15):
        text, line = " ".join(words(rng, 250)), " ".join(words(rng, 9))
        rows += [(2 * i, text), (2 * i + 1, "\n".join([text, *[line] * 20]))]
    want = kept_by_brute_force(rows)
    assert want == {2 * i for i in range(15)}
    assert kept(spark, rows) == want


def test_no_pair_is_missed(spark):
    rng, rows = random.Random(11), [(-1, ""), (-2, None), (-3, " \n")]
    line = " ".join(words(rng, 12))
    for i in range(60):  # short texts: one word more gives 4 of 5 shingles, and 3 of 4 for shorter ones
        base = words(rng, 7 + i % 3)
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join([*base, "more"]))]
    for i in range(60, 160):  # pairs on both sides of 0.8, with a line that all have, repeated in some
        base = words(rng, 120 + i)
        edited = list(base)
        for k in range(i % 10):
            edited[7 + 11 * k] = f"edit{i}"
        rows += [(10 * i, "\n".join([line, " ".join(base)])), (10 * i + 1, "\n".join([" ".join(edited), *[line] * (i % 4)]))]
    for i in range(160, 170):  # chains: each next to the one before only
        chain = words(rng, 200)
        for k in range(6):
            rows.append((10 * i + k, " ".join(chain)))
            for e in range(4):
                chain[20 * k + 5 * e + 3] = f"edit{i}.{k}.{e}"
    want = kept_by_brute_force(rows)
    assert len(rows) // 2 < len(want) < len(rows)
    assert kept(spark, rows) == want


def test_sf001_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("limit", "levels"), [(10_000, 2), (6, 2), (6, 1), (6, 0), (2, 2)])
def test_cut_buckets_lose_nothing(spark, limit, levels):
    """Sets of one crowded universe, so that buckets are over the limit again and again; some rows are joined already."""
    rng = random.Random(13)
    sets = []
    for _ in range(12):
        base = rng.sample(range(60), rng.randint(8, 30))
        for _ in range(6):
            edited = set(base) - set(rng.sample(base, rng.randint(0, 3))) | set(rng.sample(range(60), rng.randint(0, 2)))
            sets.append(np.array(sorted(edited), np.uint64))
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    comp = [k if k % 4 else 0 for k in range(len(sets))]
    rows = [(k, comp[k], len(x), [int(v) for v in jaccard.prefix(x, *none)]) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, comp long, n long, prefix array<long>")
    got = {(r.x, r.y) for r in jaccard.bucket_pairs(df, limit, levels).collect()}
    members = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and 5 * len(members[i] & members[j]) >= 4 * len(members[i] | members[j])}
    assert len(want) > 50 and want <= got
    assert all(comp[i] != comp[j] for i, j in got)


def test_odd_rows(spark):
    schema = "doc_id long, text string, digest string, fp int, gone_id int, component_id string"
    texts = [(None, None), (None, "same words of one text here now"), (3, None), (2, ""), (4, " \t"), (5, "same words of one text here now"), (5, "same words of one text here now"), (6, "Same words of one text here now"), (7, "w " * 50_000), (8, "w " * 50_001), (9, "x")]
    df = spark.createDataFrame([(i, t, "d", 1, 2, "c") for i, t in texts], schema)
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id) for r in got.collect())) == ["2", "5", "5", "7", "9", "None", "None"]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_shingles_are_counted_over_all_documents(spark):
    """A line of 45 in 15,000 documents, which a sample of every second one or fewer ranks by chance, comes last everywhere."""
    import numpy as np

    df = spark.range(15_000).selectExpr("id AS doc_id", "concat(CASE WHEN id % 333 = 0 THEN 'one line that some have ' ELSE '' END, array_join(transform(sequence(1, 12), k -> sha2(concat(id, ':', k), 256)), ' ')) AS text")
    ranks = jaccard.shingle_ranks(df, 5)
    line = jaccard.whole_set(b"one line that some have", 5)
    at = lambda h: ranks[(h & np.uint64(jaccard.CELLS - 1)).astype(np.int64)]
    assert at(line).tolist() == [int(8 * np.log2(47))]  # 46 documents
    members = jaccard.whole_set(df.filter("doc_id = 333").first()["text"].encode(), 5)
    assert jaccard.ranked(members, ranks)[-1] == line[0] and line[0] not in jaccard.prefix(jaccard.ranked(members, ranks))
