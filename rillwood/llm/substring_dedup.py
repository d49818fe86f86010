"""Substring deduplication by super-k-mer partitioning.

The least hash among the m-word pieces of a window is its minimiser. Consecutive windows of a document that share it make
up a super-k-mer, which travels once, as one packed string, to the bucket of the minimiser; equal windows have equal
minimisers, so each bucket can sort its windows and tell exactly which of them start in a document with a smaller id.

Before the shuffle, equal super-k-mers of a task are one: only the smallest document's travels, the others are known to
repeat it. A bucket that still gathers more than ``BUCKET_BYTES`` gives its windows up to a plain aggregation by window
digest, where sums are partial before they are shuffled, so no task ever holds an unbounded group.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, input_bytes, write_table

#: Words of a minimiser; text that a task holds back to find equal super-k-mers; text that a bucket may gather; buckets for
#: each shuffle partition at least, and bytes of input (files are some three times smaller than texts, packed strings three
#: times larger) for each bucket at most, so that a bucket gathers about 2 MB whatever the input.
PIECE, HOLD_BYTES, BUCKET_BYTES, BUCKETS, BUCKET_INPUT = 8, 48_000_000, 32_000_000, 48, 250_000
#: Stands for a null id, which is larger than every other.
NO_ID = (1 << 63) - 1
_HEAD = struct.Struct("<QqqiiI")  # minimiser, document, text key, first window, windows, bytes of text


def minimisers(hashes: np.ndarray, window: int, piece: int) -> np.ndarray:
    """The minimiser of each window of words with these hashes."""
    with np.errstate(over="ignore"):
        n = len(hashes) - piece + 1
        x = np.zeros(n, np.uint64)
        for k in range(piece):
            x = x * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    wide, size = window - piece + 1, 1
    while size * 2 <= wide:  # least of ever longer runs
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = wide - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def super_kmers(words: list[bytes], window: int, piece: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(minimiser, first window, number of windows, packed words) for runs of windows that share a minimiser."""
    if len(words) < window:
        return
    digest = xxhash.xxh64_intdigest
    least = minimisers(np.array([digest(w) for w in words], np.uint64), window, min(piece, window))
    ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64))
    joined = b" ".join(words)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    low = np.where(first > 0, ends[first - 1], 0)
    high = ends[first + count + window - 2] - 1
    for m, s, n, a, b in zip(least[first].tolist(), first.tolist(), count.tolist(), low.tolist(), high.tolist(), strict=True):
        yield m, s, n, joined[a:b]


def _edges(text: bytes, n: int, window: int) -> tuple[list[int], list[int]]:
    """Where each of the n windows of a packed string begins and ends."""
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(text))
    return starts[:n].tolist(), ends[window - 1 : window - 1 + n].tolist()


def _digests(text: bytes, n: int, window: int) -> np.ndarray:
    """128 bits of each window, a row each; the windows themselves are never all there at once."""
    out = b"".join(xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(*_edges(text, n, window), strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


class _Holder:
    """Super-k-mers of a task by their text: those of the smallest document travel, the others are repeats."""

    def __init__(self) -> None:
        self.held: dict[bytes, list] = {}
        self.repeats = array("q")  # (document, text key, first, end) one after another
        self.size = 0

    def add(self, doc: int, key: int, m: int, start: int, n: int, text: bytes) -> None:
        got = self.held.get(text)
        if got is None:
            self.held[text] = [m, doc, [(key, start, n)]]
            self.size += len(text) + 200
        elif doc == got[1]:
            got[2].append((key, start, n))
            self.size += 60
        elif doc > got[1]:
            self._repeat(doc, key, start, n)
        else:
            for place in got[2]:
                self._repeat(got[1], *place)
            got[1:] = [doc, [(key, start, n)]]

    def _repeat(self, doc: int, key: int, start: int, n: int) -> None:
        self.repeats.extend((doc, key, start, start + n))
        self.size += 32

    def flush(self, buckets: int) -> Iterator[pa.RecordBatch]:
        blobs, squeeze = defaultdict(list), zstandard.ZstdCompressor(level=3)
        for text, (m, doc, places) in self.held.items():
            for key, start, n in places:
                blobs[m % buckets] += [_HEAD.pack(m, doc, key, start, n, len(text)), text]
        rows = [(b, sum(map(len, parts)), squeeze.compress(b"".join(parts))) for b, parts in blobs.items()]
        rows += [(i // 200_000 % buckets, 0, self.repeats[i : i + 200_000].tobytes()) for i in range(0, len(self.repeats), 200_000)]
        self.__init__()
        for i in range(0, len(rows), 512):
            part = rows[i : i + 512]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "size", "data"])


def _unpacked(blob: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    at = 0
    while at < len(blob):
        m, doc, key, start, n, size = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        yield m, doc, key, start, n, blob[at : at + size]
        at += size


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    start = None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            yield start, i
            start = None


def repeats_of(bucket: list[tuple[int, int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int, int]]:
    """(document, text key, first, end) of runs of windows that start in a smaller document too."""
    groups: dict[int, list] = defaultdict(list)
    for row in bucket:
        groups[row[0]].append(row)
    out: list[tuple[int, int, int, int]] = []
    for rows in groups.values():
        if len({r[1] for r in rows}) < 2:  # windows of one document only
            continue
        texts: dict[bytes, list] = defaultdict(list)
        for _, doc, key, start, n, text in rows:
            texts[text].append((doc, key, start, n))
        whole = []
        for text, at in texts.items():
            least = min(a[0] for a in at)
            out += [(doc, key, start, start + n) for doc, key, start, n in at if doc > least]
            whole.append((text, [a for a in at if a[0] == least]))
        if len(whole) < 2:
            continue
        for k, runs in _repeated([(text, at[0][0], at[0][3]) for text, at in whole], window):
            out += [(doc, key, start + a, start + b) for a, b in runs for doc, key, start, _ in whole[k][1]]
    return out


def _repeated(packed: list[tuple[bytes, int, int]], window: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(place, runs of its windows that a smaller document has) for packed strings (text, document, windows).

    Windows are sorted by 128 bits and document, 40 bytes a window; each is then compared with the first of its equals.
    """
    counts = [n for _, _, n in packed]
    bits = np.concatenate([_digests(text, n, window) for text, _, n in packed])
    of = np.repeat(np.arange(len(packed), dtype=np.int32), counts)
    docs = np.array([d for _, d, _ in packed], np.int64)[of]
    within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.lexsort((docs, bits[:, 1], bits[:, 0]))
    bits = bits[order]
    first = np.concatenate([[True], (bits[1:] != bits[:-1]).any(axis=1)])
    del bits
    lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = docs[order] > docs[lead]
    edges: dict[int, tuple[list[int], list[int]]] = {}

    def words(at: int) -> bytes:
        k, i = int(of[at]), int(within[at])
        if k not in edges:
            edges[k] = _edges(packed[k][0], packed[k][2], window)
        return packed[k][0][edges[k][0][i] : edges[k][1][i]]

    flags = np.zeros(len(of), bool)
    for at, one in zip(order[later].tolist(), lead[later].tolist(), strict=True):
        if words(at) != words(one):
            raise ValueError("two windows have the same 128 bits")
        flags[at] = True
    starts = np.cumsum(counts) - counts
    for k in np.unique(of[flags]).tolist():
        yield k, list(_runs(flags[starts[k] : starts[k] + counts[k]].tolist()))


def bucket_count(size: int, partitions: int) -> int:
    return max(BUCKETS * partitions, math.ceil(size / BUCKET_INPUT))


def repeated_spans(docs: DataFrame, window: int = 50, piece: int = PIECE, bucket_bytes: int = BUCKET_BYTES, hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """(doc, key, a, b): runs of windows of ``docs`` (doc, key, text) whose words also start in a document with a smaller
    number; window i covers words i to i + window - 1."""
    spark = docs.sparkSession
    buckets = bucket_count(input_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Holder()
        for b in batches:
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()), strict=True):
                for m, start, n, packed in super_kmers((text.as_py() or b"").split(), window, piece):
                    held.add(doc, key, m, start, n, packed)
                    if held.size > hold_bytes:
                        yield from held.flush(buckets)
        yield from held.flush(buckets)

    names = ["doc", "key", "a", "b", "high", "low"]

    def rows(spans: list[tuple[int, int, int, int]], high=None, low=None) -> pa.RecordBatch:
        cols = np.array(spans, np.int64).reshape(-1, 4)
        none = pa.nulls(len(cols), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(cols[:, k])) for k in range(4)), none if high is None else pa.array(high), none if low is None else pa.array(low)], names=names)

    def given_up(bucket: list) -> Iterator[pa.RecordBatch]:
        for _, doc, key, start, n, text in bucket:
            digests = _digests(text, n, window)
            yield rows([(doc, key, start + i, start + i + 1) for i in range(n)], np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, size, over, open_up = None, [], 0, False, zstandard.ZstdDecompressor()
        for b in batches:
            for k, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n == 0:
                    yield rows(np.frombuffer(data, np.int64).reshape(-1, 4).tolist())
                    continue
                if k != now:
                    yield from given_up(bucket) if over else [rows(repeats_of(bucket, window))]
                    now, bucket, size, over = k, [], 0, False
                bucket += _unpacked(open_up.decompress(data, max_output_size=n))
                size += n
                if size > bucket_bytes:
                    yield from given_up(bucket)
                    bucket, size, over = [], 0, True
        yield from given_up(bucket) if over else [rows(repeats_of(bucket, window))]

    cuts = docs.select("doc", "key", "text").mapInArrow(cut, "bucket int, size long, data binary")
    judged = cuts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, "doc long, key long, a long, b long, high long, low long")
    judged = write_table(judged, "spans")
    found = judged.filter("high IS NULL").select("doc", "key", "a", "b")
    left = judged.filter("high IS NOT NULL")
    if not left.isEmpty():
        # written first, so that the join has a shuffle alone on either side and a window of very many documents is split
        least = write_table(left.groupBy("high", "low").agg(F.min("doc").alias("least")), "least")
        found = found.unionByName(left.join(least, ["high", "low"]).filter("doc > least").select("doc", "key", "a", "b"))
    return found


def _removed(words: list[bytes], spans: list[tuple[int, int]], window: int) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int32)
    for a, b in spans:  # windows a to b - 1
        gone[a] += 1
        gone[b - 1 + window] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, **options) -> DataFrame:
    """``docs`` with ``kept_text`` (the kept words joined by one space), ``n_words`` and ``n_removed``: each word goes that
    is covered by a window of ``window`` words which also starts in a document with a smaller id. Columns of these names
    are replaced, all others pass through.

    Words are runs of anything but ASCII whitespace, unchanged. Null text has no words. A null id counts as larger than
    every number; documents with one id, or with none, never take words from each other. An empty table gives an empty
    result.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed")
    doc, key, text, spans = free_name(docs, "doc", "key", "raw_text", "spans")
    named = docs.withColumns({text: F.col(text_col).cast("string"), doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))})
    named = named.withColumn(key, F.xxhash64(text))  # tells texts under one id apart
    found = repeated_spans(named.select(F.col(doc).alias("doc"), F.col(key).alias("key"), F.col(text).alias("text")), window, **options)
    found = found.distinct().groupBy(F.col("doc").alias(doc), F.col("key").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias(spans))
    joined = named.join(found, [doc, key], "left").select(*docs.columns, text, spans)
    n = len(docs.columns)
    schema = docs.withColumns({"kept_text": F.lit(""), "n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone = [], [], []
            for t, s in zip(b.column(n).cast(pa.large_binary()), b.column(n + 1).to_pylist(), strict=True):
                words = (t.as_py() or b"").split()
                left = _removed(words, [(x["a"], x["b"]) for x in s], window) if s else words
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                total.append(len(words))
                gone.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(remove, schema)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return drop_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL for repeats_report().
REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
m AS (SELECT win, min(doc_id) AS least FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM k JOIN m USING (win) WHERE doc_id > least),
l AS (SELECT doc_id, list(q) AS qs FROM g GROUP BY doc_id),
r AS (SELECT w.doc_id, ws, coalesce(qs, []) AS qs, list_filter(ws, lambda x, i: NOT list_contains(coalesce(qs, []), i)) AS kept FROM w LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(qs)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r
"""
