"""A quality classifier by co-training.

Two views of a document, its text and its page metadata, have a logistic regression each. Over some rounds each scores all
documents that have no label and gives labels to those that it is surest of, from which the other learns. Both are calibrated
on labelled documents that neither has seen, and a last regression on the calibrated views scores all documents. What the
views see of a document without a label is written once, in about a hundred bytes, so a round reads no text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, write_table
from .decontamination import words_of

#: Labelled documents that are fitted on at most (a fifth of them calibrate), the words of the text view, rounds of
#: co-training, pseudo-labels that a view gives a round and class, and how sure it must be to give one.
LABELLED, WORDS, ROUNDS, PSEUDO, SURE = 12_000, 256, 4, 300, 0.97
#: Parts in which the surest rows of a view and class are found before those of all.
PARTS = 64
#: Twice the log likelihood ratio that a word of the text view must have at least; chance gives few words as much.
CLEAR = 25.0
_SOURCES, _LANGS, _SIZES = 64, 16, 12
_DENSE = 13
_UPPER, _LOWER, _DIGIT = slice(0x41, 0x5B), slice(0x61, 0x7B), slice(0x30, 0x3A)


def surface(raw: bytes) -> list[float]:
    """Shape of a whole text: sizes, shares of kinds of bytes, and how much of it repeats."""
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    m = max(1, len(words))
    top = max(Counter(words).values(), default=0)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = max(1, int(c[_UPPER].sum() + c[_LOWER].sum()))
    marks = int(c[0x21:0x30].sum() + c[0x3A:0x41].sum() + c[0x5B:0x61].sum() + c[0x7B:0x7F].sum())
    return [
        math.log1p(len(words)), c[_UPPER].sum() / letters, c[_DIGIT].sum() / n, c[0x21] / m, c[0x7C] / m, marks / m, len(raw) / m / 10,
        len(set(words)) / m, top / m, twice / m, pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), c[0x80:].sum() / n,
    ]


def text_row(raw: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The text view: surface features, then which words of the vocabulary occur."""
    raw = raw or b""
    out = np.zeros(_DENSE + len(vocabulary), np.float32)
    out[:_DENSE] = surface(raw)
    for w in vocabulary.keys() & set(words_of(raw)):
        out[_DENSE + vocabulary[w]] = 1
    return out


def meta_row(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: source and language by hash, the size in powers of two."""
    out = np.zeros(_SOURCES + _LANGS + _SIZES + 1, np.float32)
    out[xxhash.xxh64_intdigest(f"s{source}") % _SOURCES] = 1
    out[_SOURCES + xxhash.xxh64_intdigest(f"l{lang}") % _LANGS] = 1
    size = math.log2(max(1, n_chars or 0))
    out[_SOURCES + _LANGS + min(_SIZES - 1, int(size))] = 1
    out[-1] = size / 16
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns by Newton's method."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 12) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        for _ in range(steps):
            p = _sigmoid(z @ w)
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
            step = np.linalg.solve(h, z.T @ (y - p) - pull * w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        self.weights = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class CoTrained:
    """What scoring needs: a few hundred words and weights, whatever the corpus."""

    vocabulary: dict[bytes, int]
    text: Logistic
    meta: Logistic
    text_cal: Logistic
    meta_cal: Logistic
    blend: Logistic
    threshold: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_cal.logit(self.text.logit(xt)[:, None])
        b = self.meta_cal.logit(self.meta.logit(xm)[:, None])
        return _sigmoid(self.blend.logit(np.stack([a, b], 1))), _sigmoid(a), _sigmoid(b)


#: (models and calibrations of the views, ids each view was given labels for) -> (view, id, label, row) to learn from.
Pick = Callable[[list[tuple[Logistic, Logistic]], list[set]], list[tuple[int, int, float, np.ndarray]]]


def picked(ids: np.ndarray, x: np.ndarray, judge: tuple[Logistic, Logistic], given: set, most: int, least: float) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(label, rows, how sure): the rows of a class that a view is surest of and that the other has no label for, one an id;
    among equals to six digits ids are taken in an order of their hashes."""
    p = _sigmoid(judge[1].logit(judge[0].logit(x)[:, None]))
    for label, sure in ((1.0, p), (0.0, 1 - p)):
        at = np.array([r for r in np.flatnonzero(sure >= least).tolist() if int(ids[r]) not in given], np.int64)
        at = at[np.lexsort((_spread(ids[at]), -np.round(sure[at], 6)))]
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])][:most]
        yield label, at, sure[at]


def _spread(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def pick_from(ids: np.ndarray, ut: np.ndarray, um: np.ndarray, most: int = PSEUDO, least: float = SURE) -> Pick:
    """Picks among documents held as arrays."""

    def pick(judges: list[tuple[Logistic, Logistic]], given: list[set]) -> list[tuple[int, int, float, np.ndarray]]:
        views = ut, um
        return [(1 - k, int(ids[r]), label, views[1 - k][r]) for k in (0, 1) for label, rows, _ in picked(ids, views[k], judges[k], given[1 - k], most, least) for r in rows] if len(ids) else []

    return pick


def co_train(vocabulary: dict[bytes, int], xt: np.ndarray, xm: np.ndarray, y: np.ndarray, fold: np.ndarray, pick: Pick) -> CoTrained:
    """Fits both views on the rows with ``fold`` false, exchanging the labels that ``pick`` gives, and calibrates on the rest."""
    fit, held = ~fold, fold if fold.any() else ~fold
    views, given = [xt, xm], [{}, {}]  # given[k]: id -> (label that the other view gave to view k, row of view k)
    models, cals = [Logistic(), Logistic()], [Logistic(), Logistic()]
    for turn in range(ROUNDS + 1):
        for k, x in enumerate(views):
            rows = [given[k][r] for r in sorted(given[k])]
            models[k].fit(np.vstack([x[fit], *(r[None] for _, r in rows)]), np.concatenate([y[fit], [label for label, _ in rows]]))
            cals[k].fit(models[k].logit(x[held])[:, None], y[held])
        found = pick(list(zip(models, cals, strict=True)), [set(g) for g in given]) if turn < ROUNDS else []
        for k, i, label, row in found:
            given[k].setdefault(i, (label, row))
        if not found:
            break
    logits = np.stack([c.logit(m.logit(x[held])[:, None]) for c, m, x in zip(cals, models, views, strict=True)], 1)
    blend = Logistic().fit(logits, y[held])
    p = _sigmoid(blend.logit(logits))
    cuts = np.unique(np.concatenate([[0.5], np.linspace(0.05, 0.95, 19)]))
    good, bad = max(1, int(y[held].sum())), max(1, int((1 - y[held]).sum()))
    # a good document lost costs as much as a bad one kept; of equal cuts the one nearest to a half
    cost = [(round((p[y[held] == 1] < c).sum() / good + (p[y[held] == 0] >= c).sum() / bad, 6), abs(c - 0.5)) for c in cuts]
    return CoTrained(vocabulary, models[0], models[1], cals[0], cals[1], blend, float(cuts[cost.index(min(cost))]))


def _sample(df: DataFrame, key: str, most: int, salt: str) -> DataFrame:
    """About ``most`` rows at most, the same ones each time, by a hash of the key."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_000_007)) < int(most * 1_000_000_007 // n))


def _packed(x: np.ndarray) -> bytes:
    """A text row in few bytes: the surface as it is, the words as bits."""
    return x[:_DENSE].tobytes() + np.packbits(x[_DENSE:] > 0).tobytes()


def _unpacked(raw: list[bytes], words: int) -> np.ndarray:
    size = 4 * _DENSE
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    bits = np.unpackbits(flat[:, size:], axis=1)[:, :words] if words else np.empty((len(raw), 0), np.uint8)
    return np.hstack([np.ascontiguousarray(flat[:, :size]).view(np.float32), bits.astype(np.float32)])


def pick_among(pool: DataFrame, words: int, most: int, least: float) -> Pick:
    """Picks among all rows of ``pool`` (id, view, source, lang, n_chars), in one pass a round; a batch gives its own surest rows, of
    which the surest of all come to the driver: ``most`` a view and class."""

    def pick(judges: list[tuple[Logistic, Logistic]], given: list[set]) -> list[tuple[int, int, float, np.ndarray]]:
        shared = pool.sparkSession.sparkContext.broadcast((judges, given))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judges, given = shared.value
            for b in batches:
                if b.num_rows == 0:
                    continue
                ids, xt = b.column(0).to_numpy(), _unpacked(b.column(1).to_pylist(), words)
                xm = np.stack([meta_row(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)])
                for k, x in enumerate((xt, xm)):
                    for label, rows, sure in picked(ids, x, judges[k], given[1 - k], most, least):
                        to = pa.array(np.full(len(rows), 1 - k, np.int32))
                        yield pa.RecordBatch.from_arrays([to, pa.array(np.full(len(rows), label)), pa.array(np.round(sure, 6)), pa.array(_spread(ids[rows])), *(c.take(pa.array(rows)) for c in b.columns)], names=["to", "label", "sure", "tie", *b.schema.names])

        found = pool.mapInArrow(run, "to int, label double, sure double, tie long, id long, view binary, source string, lang string, n_chars long")
        # one row an id; then the surest of each of many parts, and of those the surest of all
        least_first = F.min(F.struct((-F.col("sure")).alias("sure"), "view", "source", "lang", "n_chars"))
        found = found.groupBy("to", "label", "id", "tie").agg(least_first.alias("b")).select("to", "label", (-F.col("b.sure")).alias("sure"), "tie", "id", "b.view", "b.source", "b.lang", "b.n_chars")
        found = found.withColumn("part", F.pmod("tie", F.lit(PARTS)))
        for by in (["to", "label", "part"], ["to", "label"]):
            order = W.partitionBy(*by).orderBy(F.desc("sure"), "tie", "id")
            found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")
        got = found.drop("part").collect()
        shared.unpersist()
        got.sort(key=lambda r: (r.to, r.label, -r.sure, r.tie, bytes(r.view), str(r.source), str(r.lang), r.n_chars or 0))
        return [(r.to, r.id, r.label, meta_row(r.source, r.lang, r.n_chars) if r.to else _unpacked([bytes(r.view)], words)[0]) for r in got]

    return pick


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, words: int = WORDS, pseudo: int = PSEUDO, sure: float = SURE) -> CoTrained:
    """Learns which documents are good (quality 1 and not toxic) from ``labels`` (doc_id, quality, toxic).

    It is fitted on a sample of at most about ``labelled`` labelled documents, and each view may give labels to ``pseudo`` of all
    other documents a round and class, where it is at least so ``sure``; the text view has ``words`` words. Rows with a null id, quality or toxic and ids with two
    verdicts teach nothing; of rows with one id the least by (text, source, lang, n_chars) teaches, and
    of unlabelled ones the one that is surest is given a label, once a view. Without labels, or with
    one class only, every document scores alike.
    """
    spark = docs.sparkSession
    verdicts = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    verdicts = verdicts.agg(F.min(F.expr("cast(quality = 1 AND toxic = 0 AS int)")).alias("good"), F.max(F.expr("cast(quality = 1 AND toxic = 0 AS int)")).alias("most")).filter("good = most")
    chosen = write_table(_sample(verdicts.select("id", "good"), "id", labelled, "labelled"), "verdicts")
    held = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in (("source", "string"), ("lang", "string"), ("n_chars", "long"))])
    held = held.filter("id IS NOT NULL")
    fields = ["text", "source", "lang", "n_chars"]
    one = held.join(F.broadcast(chosen), "id").groupBy("id", "good").agg(F.min(F.struct(*fields)).alias("d"))  # at most a row an id comes to the driver
    taught = write_table(one.select("id", "good", "d.*"), "taught")

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, g in zip(b.column(0).cast(pa.large_binary()), b.column(1).to_pylist(), strict=True):
                total[g].update(set(words_of(t.as_py())))
        for g, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([g] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "good", "n"])

    sizes = dict(taught.groupBy("good").count().collect())
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    counts = taught.select("text", "good").mapInArrow(word_counts, "word binary, good int, n long").groupBy("word").agg(F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("good") == 0, F.col("n")).otherwise(0)).alias("b"))
    # twice the log likelihood ratio of a word's table: in how many good and bad documents it is, and in how many it isn't
    part = lambda seen, of, share: F.when(seen > 0, seen * F.log(seen / (F.lit(of) * share))).otherwise(0.0)
    share = (F.col("a") + F.col("b")) / F.lit(max(1, good + bad))
    surprise = 2 * (part(F.col("a"), good, share) + part(F.col("b"), bad, share) + part(good - F.col("a"), good, 1 - share) + part(bad - F.col("b"), bad, 1 - share))
    top = counts.filter("a + b >= 5").withColumn("z", F.round(surprise, 9)).filter(F.col("z") >= CLEAR).orderBy(F.desc("z"), "word").select("word").limit(words).collect() if good and bad else []
    vocabulary = {bytes(r[0]): k for k, r in enumerate(top)}

    def rows(df: DataFrame) -> tuple[list, np.ndarray, np.ndarray, list]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [text_row(t.as_py(), vocabulary) for t in b.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tobytes() for g in got], pa.binary()), *b.columns[2:]], names=["id", "xt", "source", "lang", "n_chars", "good"])

        got = df.select("id", "text", "source", "lang", "n_chars", "good").mapInArrow(run, "id long, xt binary, source string, lang string, n_chars long, good int").collect()
        got.sort(key=lambda r: (r.id, bytes(r.xt), str(r.source), str(r.lang), r.n_chars or 0))
        xt = np.frombuffer(b"".join(bytes(r.xt) for r in got), np.float32).reshape(len(got), _DENSE + len(vocabulary))
        xm = np.array([meta_row(r.source, r.lang, r.n_chars) for r in got], np.float32).reshape(len(got), _SOURCES + _LANGS + _SIZES + 1)
        return [r.id for r in got], xt, xm, [r.good for r in got]

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [_packed(text_row(t.as_py(), vocabulary)) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seen, pa.binary()), *b.columns[2:]], names=["id", "view", "source", "lang", "n_chars"])

    ids, xt, xm, y = rows(taught)
    y = np.array(y, np.float64)
    fold = np.array([xxhash.xxh64_intdigest(str(i), 5) % 5 == 0 for i in ids], bool)
    if not (good and bad):  # nothing to exchange
        return co_train(vocabulary, xt, xm, y, fold, lambda judges, given: [])
    rest = held.join(F.broadcast(chosen.select("id")), "id", "left_anti").select("id", *fields)
    pool = write_table(rest.mapInArrow(views, "id long, view binary, source string, lang string, n_chars long"), "views")
    return co_train(vocabulary, xt, xm, y, fold, pick_among(pool, len(vocabulary), pseudo, sure))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1), ``text_score``, ``meta_score`` and ``accepted``; columns of these names are
    replaced, all others pass through. Every whole text is scored in one pass without a shuffle. Null text counts as empty,
    other null columns as values of their own. An empty table gives an empty result."""
    docs = docs.drop("quality_score", "text_score", "meta_score", "accepted")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    n = len(docs.columns)
    t, s, g, c = free_name(docs, "t", "s", "g", "c")
    pick = lambda name, kind: F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    held = docs.withColumns({t: F.col("text").cast("string"), s: pick("source", "string"), g: pick("lang", "string"), c: pick("n_chars", "long")})
    schema = held.select(*docs.columns).withColumns({"quality_score": F.lit(0.0), "text_score": F.lit(0.0), "meta_score": F.lit(0.0), "accepted": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if b.num_rows == 0:
                continue
            xt = np.stack([text_row(x.as_py(), m.vocabulary) for x in b.column(n).cast(pa.large_binary())])
            xm = np.stack([meta_row(*x) for x in zip(*(b.column(n + k).to_pylist() for k in (1, 2, 3)), strict=True)])
            p, a, q = m.score(xt, xm)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p), pa.array(a), pa.array(q), pa.array(p >= m.threshold)], names=schema.names)

    return held.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    return score_quality(docs, labels).filter("accepted").select(*docs.columns)
