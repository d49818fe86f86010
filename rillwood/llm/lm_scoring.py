"""Language-model scoring by deleted interpolation.

A token's probability after its predecessor mixes the maximum-likelihood estimates of the bigram and the word with an even
share for every token: p(w | v) = a(b) c(v, w) / c(v) + d(b) c(w) / N + e(b) / (V + 1), where b is the bucket of c(v), in
powers of two. The weights of each bucket are learned by expectation-maximisation on the counts of documents kept out of
the training counts; then all training documents count.

Documents stay where they are. Each batch of documents asks for the counts of its distinct words and bigrams, with what it
adds to them, at the buckets of their hashes; each bucket sums what all batches add and answers. A word or bigram is one
number a batch, however often it occurs, so no bucket is hot, and what travels grows with the distinct ones alone. Tokens
are told apart by 64-bit XXH64.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, input_bytes, write_table

#: Tokens of a batch of documents; buckets of context counts, 0 for unseen ones; steps of expectation-maximisation; steps of
#: the histogram for each power of two, and powers of two of it at most.
BATCH_TOKENS, CONTEXTS, STEPS, FINE, POWERS = 1_250_000, 26, 40, 4, 40
#: Tokens that are scored at a time; keys of a bucket that are summed at a time, and how many such ranges have numbers of
#: their own; bytes of input for each bucket, and buckets at most: with more a batch would ask each for a few keys only.
SLICE, RANGE_KEYS, MOST_RANGES, BUCKET_BYTES, MOST_BUCKETS = 65_536, 4_000_000, 1 << 16, 8_000_000, 65_536
#: One in so many training documents teaches the weights.
KEPT_OUT = 8
_END, _START = np.uint64(xxhash.xxh64_intdigest(b"\n")), np.uint64(xxhash.xxh64_intdigest(b"\n\n"))  # no word has a line break
_WORDS, _PAIRS, _RECORD, _TOTALS = 0, 1, 2, 3
_SCHEMA = "batch long, kind int, bucket long, n long, data binary"
_NAMES = ["batch", "kind", "bucket", "n", "data"]


def tokens_of(raw: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, and of its end."""
    digest = xxhash.xxh64_intdigest
    return np.array([*map(digest, (raw or b"").lower().split()), int(_END)], np.uint64)


def pairs_of(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (words + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _pair_keys(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bigram of each token with its predecessor, or the start of its text; then a start for each text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = _START
    return np.concatenate([pairs_of(before, words), np.full(len(starts), _START)])


def _squeeze(a: np.ndarray, level: int = 3) -> bytes:
    """Bytes of the same rank together, compressed."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), level)


def _opened(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def _together(*parts: bytes) -> bytes:
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def _apart(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    at, out = 4 + 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", data, 4):
        out.append(data[at : at + size])
        at += size
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys begins and the last one ends; buckets are even ranges of hashes."""
    tops = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(tops, np.uint64)), [len(keys)]])


def _counted(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """How often each of the sorted distinct ``among`` is in ``keys``."""
    out = np.zeros(len(among), np.int32)
    have, counts = np.unique(keys, return_counts=True)
    out[np.searchsorted(among, have)] = counts
    return out


def _batch_rows(batch: int, docs: list[tuple[int | None, int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The questions of a batch of (doc_id, role, tokens) and its record. Roles: 0 counts, 1 teaches the weights, 2 is held
    out."""
    sizes = np.array([len(t) for _, _, t in docs], np.int64)
    role = np.repeat(np.array([r for _, r, _ in docs], np.int8), sizes)
    words = np.concatenate([t for _, _, t in docs])
    starts = np.cumsum(sizes) - sizes
    ids = np.array([0 if i is None else i for i, _, _ in docs], np.int64)
    flags = np.array([(i is None) + 2 * (r == 2) for i, r, _ in docs], np.uint8)
    docs.clear()
    at, kinds = None, 0
    for kind in (_WORDS, _PAIRS):
        keys, roles = (words, role) if kind == _WORDS else (_pair_keys(words, starts), np.concatenate([role, role[starts]]))
        distinct = np.unique(keys)
        fit, taught = _counted(keys[roles == 0], distinct), _counted(keys[roles == 1], distinct)
        del keys, roles
        edges = _bucket_edges(distinct, buckets)
        rows = []
        for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if hi > lo:
                step = np.diff(distinct[lo:hi], prepend=np.uint64(0))
                rows.append((batch, kind, b, hi - lo, _together(_squeeze(step), _squeeze(fit[lo:hi]), _squeeze(taught[lo:hi]))))
        yield _rows(rows)
        if kind == _WORDS:
            at, kinds = np.searchsorted(distinct, words).astype(np.int32), len(distinct)
    # frequent words have small numbers, which take little room; bigrams follow from the words
    order = np.argsort(-np.bincount(at, minlength=kinds), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    record = _together(_squeeze(ids), _squeeze(flags), _squeeze(sizes), _squeeze(rank[at]), _squeeze(order.astype(np.int32)), struct.pack("<QQ", len(words), len(order)))
    yield _rows([(batch, _RECORD, -1, len(ids), record)])


def _ask(docs: DataFrame, buckets: int, batch_tokens: int) -> DataFrame:
    """Questions and records of all documents (doc_id, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}  # documents that teach the weights have batches of their own
        size, part, made = {True: 0, False: 0}, None, 0

        def name(docs: list, kind: bool) -> int:
            # a batch's number: the same when a lost task runs again, another one for each batch; odd if it teaches
            nonlocal made
            made += 1
            h = xxhash.xxh64(f"{part} {made}")
            for i, _, t in docs:
                h.update(repr((i, len(t))).encode())
                h.update(t.tobytes())
            return (h.intdigest() >> 2) * 2 + kind

        for b in batches:
            if b.num_rows == 0:
                continue
            part = b.column(3)[0].as_py() if part is None else part
            for i, r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), strict=True):
                kind, t = r == 1, tokens_of(text.as_py())
                held[kind].append((i, r, t))
                size[kind] += len(t)
                if size[kind] >= batch_tokens:
                    yield from _batch_rows(name(held[kind], kind), held[kind], buckets)  # which empties it
                    size[kind] = 0
        for kind, rest in held.items():
            if rest:
                yield from _batch_rows(name(rest, kind), rest, buckets)

    return docs.select("doc_id", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(run, _SCHEMA)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Rows one at a time, so that a batch's data is there once."""
    for b in batches:
        numbers = [c.to_pylist() for c in b.columns[:4]]
        for i in range(b.num_rows):
            yield *(c[i] for c in numbers), b.column(4)[i].as_py()


def _answering(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums each bucket's counts and answers every question in the order it was asked; records pass through.

    Questions stay compressed, and a bucket of many keys is summed in ranges of hashes of about ``RANGE_KEYS`` keys, each of
    which has answers of its own.
    """

    def answers(bucket: int, kind: int, asked: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        ranges = min(MOST_RANGES, sum(n for _, n, _ in asked) // RANGE_KEYS + 1)
        low, high, sums = (bucket << 64) // buckets, ((bucket + 1) << 64) // buckets, np.zeros(4, np.int64)
        for r in range(ranges):
            ends = np.array([low + (high - low) * r // ranges, low + (high - low) * (r + 1) // ranges - 1], np.uint64)
            keys, fit, taught, batch_of = [], [], [], []
            for batch, n, data in asked:
                k, f, t = _apart(data)
                k = np.cumsum(_opened(k, n, np.uint64), dtype=np.uint64)
                lo, hi = int(np.searchsorted(k, ends[0])), int(np.searchsorted(k, ends[1], side="right"))
                if hi > lo:
                    keys.append(k[lo:hi].copy())
                    fit.append(_opened(f, n, np.int32)[lo:hi].copy())
                    taught.append(_opened(t, n, np.int32)[lo:hi].copy())
                    batch_of.append(batch)
            if not keys:
                continue
            every = np.concatenate(keys)
            distinct = np.unique(every)
            fits, more = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            for k, f, t in zip(keys, fit, taught, strict=True):  # the keys of one batch are distinct
                own = np.searchsorted(distinct, k)
                fits[own] += f
                more[own] += t
            sums += [fits.sum(), (fits > 0).sum(), (fits + more).sum(), (fits + more > 0).sum()]
            for batch, k in zip(batch_of, keys, strict=True):
                own = np.searchsorted(distinct, k)
                step = _squeeze(np.diff(k, prepend=np.uint64(0))) if kind == _WORDS else b""  # words go back with their hashes
                yield _rows([(batch, kind, bucket * MOST_RANGES + r, len(k), _together(_squeeze(fits[own]), _squeeze(more[own]), step))])
        if kind == _WORDS:
            yield _rows([(-1, _TOTALS, bucket, 0, struct.pack("<4q", *sums.tolist()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for batch, kind, bucket, n, data in _each(batches):
            if kind == _RECORD:
                yield _rows([(batch, kind, bucket, n, data)])
                continue
            if (bucket, kind) != now:
                if asked:
                    yield from answers(*now, asked)
                now, asked = (bucket, kind), []
            asked.append((batch, n, data))
        if asked:
            yield from answers(*now, asked)

    return run


class _Resolved:
    """A batch with the counts of its tokens, their predecessors and their bigrams."""

    def __init__(self, record: tuple[int, bytes], counts: dict[int, list[tuple[int, bytes]]]):
        n, data = record
        ids, flags, sizes, rank_at, order, rest = _apart(data)
        total, kinds = struct.unpack("<QQ", rest)
        self.ids, self.flags, self.sizes = _opened(ids, n, np.int64), _opened(flags, n, np.uint8), _opened(sizes, n, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word_at = _opened(order, kinds, np.int32)[_opened(rank_at, total, np.int32)]
        self.counts, hashes = {}, []
        for kind, parts in counts.items():
            both = []
            for k, d in parts:
                f, t, step = _apart(d)
                both.append((_opened(f, k, np.int64), _opened(t, k, np.int64)))
                if kind == _WORDS:
                    hashes.append(np.cumsum(_opened(step, k, np.uint64), dtype=np.uint64))
            fit, more = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
            more += fit
            self.counts[kind] = (fit, more)
            parts.clear()
        self.hashes = np.concatenate(hashes)
        self.pairs = np.unique(_pair_keys(self.hashes[self.word_at], self.starts))

    def numbers(self, every: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(lo, hi, c(w), c(v, w), c(v)) of the tokens lo to hi - 1, ``SLICE`` at a time."""
        words, pairs = self.counts[_WORDS][every], self.counts[_PAIRS][every]
        begun = pairs[np.searchsorted(self.pairs, _START)]
        for lo in range(0, len(self.word_at), SLICE):
            at = self.word_at[lo : lo + SLICE]
            hi = lo + len(at)
            before = self.word_at[max(0, lo - 1) : hi - 1] if lo else np.concatenate([at[:1], at[:-1]])
            first = self.starts[np.searchsorted(self.starts, lo) : np.searchsorted(self.starts, hi)] - lo
            w, v, left = words[at], words[before], self.hashes[before]
            v[first], left[first] = begun, _START
            yield lo, hi, w, pairs[np.searchsorted(self.pairs, pairs_of(left, self.hashes[at]))], v

    def add(self, out: np.ndarray, lo: int, hi: int, x: np.ndarray) -> None:
        """Adds what the tokens lo to hi - 1 have to the sums of their documents."""
        first, last = np.searchsorted(self.starts, [lo, hi - 1], side="right") - 1
        out[first : last + 1] += np.add.reduceat(x, np.maximum(self.starts[first : last + 1] - lo, 0))


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than the whole part of the count's binary logarithm."""
    return np.where(c > 0, np.minimum(np.frexp(np.maximum(c, 1).astype(np.float64))[1], CONTEXTS - 1), 0)


def estimates(w: np.ndarray, vw: np.ndarray, v: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """The three estimates that are mixed, a row each."""
    return np.stack([vw / np.maximum(v, 1), w / max(1, n), np.full(len(w), 1 / (kinds + 1))])


def learn_weights(codes: np.ndarray, counts: np.ndarray, kinds: int) -> np.ndarray:
    """Weights (context bucket, estimate) from a histogram of kept-out tokens by expectation-maximisation."""
    steps = FINE * POWERS + 2
    bucket, two, one = codes // (steps * steps), codes // steps % steps, codes % steps
    level = lambda q: np.where(q == steps - 1, 0.0, 2.0 ** (-q / FINE))
    f = np.stack([level(two), level(one), np.full(len(codes), 1 / (kinds + 1))])

    def run(at: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, x, c = first.copy(), f[:, at], counts[at]
        for _ in range(STEPS):
            share = a[:, None] * x
            share *= c / np.maximum(share.sum(axis=0), 1e-300)
            a = share.sum(axis=1) + 1e-3 * first  # a breath of the start keeps every weight above zero
            a /= a.sum()
        return a

    start = np.array([0.5, 0.4, 0.1])
    whole = run(np.arange(len(codes)), start) if len(codes) else start
    out = np.tile(whole, (CONTEXTS, 1))
    for b in range(CONTEXTS):
        if (at := np.flatnonzero(bucket == b)).size:
            out[b] = run(at, whole)
    out[0, 0] = 0  # without its context a bigram can't have been seen
    return out / out.sum(axis=1, keepdims=True)


def _level(f: np.ndarray) -> np.ndarray:
    steps = FINE * POWERS + 2
    q = np.rint(-FINE * np.log2(np.maximum(f, 2.0**-POWERS))).astype(np.int64)
    return np.where(f > 0, q, steps - 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[_Resolved]:
    """Batches from rows sorted by (batch, kind, bucket)."""
    now, counts = None, {_WORDS: [], _PAIRS: []}
    for batch, kind, _, n, data in _each(batches):
        if batch != now:
            now, counts = batch, {_WORDS: [], _PAIRS: []}
        if kind == _RECORD:  # the last of its batch
            yield _Resolved((n, data), counts)
        else:
            counts[kind].append((n, data))


def bucket_count(docs: DataFrame) -> int:
    """As many buckets as shuffle partitions, or more where the input is known to be large: one for each ``BUCKET_BYTES``."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(input_bytes(docs) // BUCKET_BYTES, MOST_BUCKETS))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 1, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``,
    learned from the rows whose crc32(id as text) mod ``folds`` isn't ``held_out_fold``.

    Scores are base-10 logarithms of the whole text's probability: the base score under add-half unigrams, the score under
    the interpolated model. Null text counts as empty and has the end as its only token; a null id counts as the empty text
    in the split; repeated rows count and are scored each. An empty table gives an empty result; without training rows all
    estimates are even shares. Other columns aren't read.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    role = F.when(crc_mod(F.col(id_col), folds) == held_out_fold, 2).when(F.floor(crc / F.lit(folds)) % KEPT_OUT == 0, 1).otherwise(0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), role.cast("int").alias("role"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(rows)

    place = F.when(F.col("kind") == _RECORD, F.pmod(F.col("batch"), F.lit(buckets))).otherwise(F.col("bucket"))
    asked = _ask(rows, buckets, batch_tokens).repartition(buckets, place).sortWithinPartitions("bucket", "kind")
    told = write_table(asked.mapInArrow(_answering(buckets), _SCHEMA), "counts")
    sums = np.array([struct.unpack("<4q", bytes(r[0])) for r in told.filter(F.col("kind") == _TOTALS).select("data").collect()], np.int64).reshape(-1, 4).sum(axis=0)
    n_fit, v_fit, n_all, v_all = map(int, sums)
    told = told.filter(F.col("kind") != _TOTALS)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = FINE * POWERS + 2
        for r in _gathered(batches):
            for _, _, w, vw, v in r.numbers(False):
                f = estimates(w, vw, v, n_fit, v_fit)
                codes, counts = np.unique((context_bucket(v) * steps + _level(f[0])) * steps + _level(f[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    # so many partitions that each has few batches; what is read again is sorted by batch, so one batch is held
    lessons = told.filter(F.col("batch") % 2 == 1).repartition(buckets, "batch").sortWithinPartitions("batch", "kind", "bucket")
    found = np.array(lessons.mapInArrow(histogram, "code long, n long").groupBy("code").agg(F.sum("n")).collect(), np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    weights = learn_weights(found[:, 0], found[:, 1].astype(np.float64), v_fit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _gathered(batches):
            known, bases, scores = (np.zeros(len(r.ids), t) for t in (np.int64, np.float64, np.float64))
            for lo, hi, w, vw, v in r.numbers(True):
                mixed = weights[context_bucket(v)].T
                p = (mixed * estimates(w, vw, v, n_all, v_all)).sum(axis=0)
                r.add(known, lo, hi, (w > 0).astype(np.int64))
                r.add(bases, lo, hi, np.log10((w + 0.5) / (n_all + 0.5 * (v_all + 1))))
                r.add(scores, lo, hi, np.log10(p))
            cols = [pa.array(r.ids, mask=(r.flags & 1).astype(bool)), pa.array((r.flags & 2) > 0), pa.array(r.sizes), pa.array(known), pa.array(np.full(len(r.ids), n_all)), pa.array(bases), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    ordered = told.repartition(buckets, "batch").sortWithinPartitions("batch", "kind", "bucket")
    return ordered.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
