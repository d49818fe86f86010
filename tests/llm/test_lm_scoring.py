"""Deleted interpolation against a plain count of everything."""

import math
import zlib
from collections import Counter

import numpy as np

from rillwood.llm import lm_scoring


def brute(rows, weights_of):
    """Scores by Counter, with the operator's weights."""
    split = {i: zlib.crc32(("" if i is None else str(i)).encode()) for i, _ in rows}
    docs = [(i, [*("" if t is None else t).encode().lower().split(), b"\n"]) for i, t in rows]
    train = [(i, w) for i, w in docs if split[i] % 5 != 1]
    uni, bi, start = Counter(), Counter(), len(train)
    for _, w in train:
        uni.update(w)
        bi.update(zip([None, *w[:-1]], w, strict=True))
    n, kinds = sum(uni.values()), len(uni)
    out = {}
    for i, w in docs:
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (kinds + 1))) for x in w)
        score = 0.0
        for v, x in zip([None, *w[:-1]], w, strict=True):
            c = start if v is None else uni[v]
            a = weights_of(c)
            score += math.log10(a[0] * (bi[v, x] / c if c else 0) + a[1] * uni[x] / n + a[2] / (kinds + 1))
        out[i] = (split[i] % 5 == 1, len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


def test_query_matches_brute_force(spark, sf_dir, monkeypatch):
    seen = {}
    learn = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in lm_scoring.score_documents(docs, batch_tokens=5_000).collect()}
    weights = seen["w"]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], lambda c: weights[int(lm_scoring.context_bucket(np.array([c]))[0])])
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert math.isclose(got[i][4], w[4], rel_tol=1e-9) and math.isclose(got[i][5], w[5], rel_tol=1e-9)
    held = [i for i, w in want.items() if w[0]]
    assert sum(got[i][5] for i in held) > sum(got[i][4] for i in held)  # better than the base on what it hasn't seen


def test_weights_are_those_of_a_plain_em(spark, sf_dir, monkeypatch):
    """Weights by expectation-maximisation over every kept-out token, from plain counts; the query rounds estimates to a
    quarter of a power of two."""
    seen, learn = {}, lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lm_scoring.score_documents(docs, batch_tokens=5_000).count()
    uni, bi, fits, kept = Counter(), Counter(), 0, []
    for r in docs.collect():
        crc, w = zlib.crc32(str(r.doc_id).encode()), [*(r.text or "").encode().lower().split(), b"\n"]
        if crc % 5 != 1 and crc // 5 % 8 == 0:
            kept.append(w)
        elif crc % 5 != 1:
            fits += 1
            uni.update(w)
            bi.update(zip([None, *w[:-1]], w, strict=True))
    n, by = sum(uni.values()), {}
    for w in kept:
        for v, x in zip([None, *w[:-1]], w, strict=True):
            c = fits if v is None else uni[v]
            by.setdefault(0 if not c else c.bit_length(), []).append((bi[v, x] / c if c else 0.0, uni[x] / n, 1 / (len(uni) + 1)))

    def em(estimates, first):
        a = np.array(first)
        for _ in range(40):
            share = a * np.array(estimates)
            a = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 1e-3 * np.array(first)
            a /= a.sum()
        return a

    whole, compared = em([e for es in by.values() for e in es], [0.5, 0.4, 0.1]), 0
    for bucket, es in by.items():
        if len(es) >= 100:
            want = em(es, whole)
            if not bucket:
                want = np.array([0, *want[1:]]) / want[1:].sum()
            assert np.abs(seen["w"][bucket] - want).max() < 0.03, (bucket, seen["w"][bucket], want)
            compared += 1
    assert compared >= 4


def test_weights_follow_the_data():
    steps = lm_scoring.FINE * lm_scoring.POWERS + 2
    code = lambda b, two, one: (b * steps + two) * steps + one
    codes = np.array([code(3, 4, 40), code(5, steps - 1, 20)])  # bucket 3: the bigram says 1/2; bucket 5: it says 0
    w = lm_scoring.learn_weights(codes, np.array([1000.0, 1000.0]), 10_000)
    assert w[3, 0] > 0.9 and w[5, 0] < 0.05 and w[5, 1] > 0.8
    assert w[0, 0] == 0 and np.allclose(w.sum(axis=1), 1)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, "A b a"), (1, "A b a"), (2, " x" * 20_000), (3, "b \x0b A")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, word string")
    got = lm_scoring.score_documents(df).collect()
    assert len(got) == 6
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 4, 4, 20_001]
    assert len({(r.base_score, r.score) for r in got if r.n_tokens == 4}) == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm_scoring.score_documents(df.limit(0)).count() == 0
