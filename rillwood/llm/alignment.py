"""Two tokenizers over the same texts, aligned by bytes.

Each text is encoded by both; the byte offsets at which tokens of both end cut it into groups, and every token of one side is
linked with every token of the other in its group. A document's links are counted by pair of ids. Batches of documents pack
these multiplicities into postings by side id (the first tokenizer's): the partner ids, in how many documents of the batch
each is linked, and the documents with their multiplicities. Sums of the batch counts over the corpus, one list a side id,
which the other vocabulary bounds, and the postings are then shuffled by side id and read as sorted streams that spill: each
task has a side id's counts first, takes their maximum and reads its postings past them, a batch's at a time. What that adds
to documents goes back packed by batch and is summed by document. A side id with many postings is dealt to many tasks, each with a copy of its counts.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, write_table

#: Bytes and documents of a batch; links that are counted at a time; postings that are added up at a time.
BATCH_BYTES, BATCH_DOCS, LINKS, POSTINGS = 4_000_000, 1 << 16, 1 << 20, 1 << 20
#: Bytes of input for each partition of postings at most; slices of a side id's postings, for each partition.
PART_BYTES, SLICES = 64 << 20, 4
#: Bytes of a vocabulary file, which is broadcast, at most.
MOST_VOCABULARY = 64 << 20
#: A run of white space this long overflows the stack of the faster encoder.
LONG_SPACE = 10_000
#: Fixed: how the byte-level vocabulary's tokenizer splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ID, _DOC = 20, 24  # bits of an id and of a document's place in its batch
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, first long, b array<int>, n array<int>, docs binary, times binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}


class Sides:
    """Both tokenizers from the bytes of their files, with the bytes of each id."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        back = byte_of_character()
        vocabulary = {bytes(map(back.__getitem__, t)): i for t, i in json.loads(byte_level)["model"]["vocab"].items()}
        self._fast = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})  # ids are in the order of merges
        self._slow = Tokenizer.from_buffer(byte_level)
        self._slow.encode_special_tokens = True
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self._space = re.compile(r"\s{%d}" % LONG_SPACE)
        n = self._pieces.get_piece_size()
        texts = [self._pieces.id_to_piece(i) for i in range(n)]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = t
        self.bytes_b = [bytes([int(t[1:-1], 16)]) if self._pieces.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
        if max(len(self.bytes_a), n) >= 1 << _ID:
            raise ValueError("a vocabulary has too many ids")
        self.lengths_a, self.lengths_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        kind = f"S{len(str(max(len(self.bytes_a), n))) + 1}"
        self.spelled = np.array([f"{i}{mark}" for i in range(max(len(self.bytes_a), n)) for mark in ",|;"], kind)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids; nothing where their bytes aren't those of a space and the text."""
        if not text:
            return None
        raw = f" {text}"
        if len(raw) >= LONG_SPACE and self._space.search(raw):
            a = np.array(self._slow.encode(raw, add_special_tokens=False).ids, np.int64)
        else:
            a = np.array(self._fast.encode_ordinary(raw), np.int64)
        b = np.array(self._pieces.encode(text), np.int64)
        whole = raw.encode()
        if any(b"".join(map(table.__getitem__, ids.tolist())) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token's group, on both sides."""
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        out = []
        for ends, others in ((ends_a, ends_b), (ends_b, ends_a)):
            at = np.zeros(ends_a[-1] + 1, bool)
            at[others] = True
            both = at[ends]
            out.append(np.cumsum(both) - both)
        return out[0], out[1]

    def digest(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> str:
        """SHA-256 of the groups spelled out: a1,a2|b1;a3|b2,b3."""
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga]] = a * 3 + np.append(ga[1:] != ga[:-1], True)
        codes[np.arange(len(b)) + np.cumsum(in_a)[gb]] = b * 3 + 2 * np.append(gb[1:] != gb[:-1], True)
        return hashlib.sha256(self.spelled[codes].tobytes().translate(None, b"\0")[:-1]).hexdigest()


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their numbers."""
    keys, numbers = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(numbers, starts) if len(keys) else numbers


def link_counts(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of groups that follow one another, with ``in_a`` and ``in_b`` tokens each, in document ``doc``: the
    distinct (a, b, document) as sorted numbers, and how often each is there."""
    links, starts_a, starts_b = in_a * in_b, np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for g in np.flatnonzero(links > LINKS):  # ids of a large group that come again are multiplied, not listed
        ua, ca = np.unique(a[starts_a[g] : starts_a[g] + in_a[g]], return_counts=True)
        ub, cb = np.unique(b[starts_b[g] : starts_b[g] + in_b[g]], return_counts=True)
        step = max(1, LINKS // len(ub))
        for k in range(0, len(ua), step):
            keys = (ua[k : k + step, None] << (_ID + _DOC)) | (ub << _DOC)[None, :] | doc[g]
            parts.append((keys.ravel(), (ca[k : k + step, None] * cb[None, :]).ravel()))
    links = np.where(links > LINKS, 0, links)
    cuts = np.searchsorted(np.cumsum(links), np.arange(0, links.sum() + LINKS, LINKS), "left")
    for low, high in zip(cuts, np.append(cuts[1:], len(links))):
        p, q = np.where(links[low:high] > 0, in_a[low:high], 0), in_b[low:high]
        of = np.repeat(np.arange(len(p)), p)  # the group of each token of the first side
        n = q[of]
        place_a = np.repeat(np.repeat(starts_a[low:high], p) + np.arange(len(of)) - np.repeat(np.cumsum(p) - p, p), n)
        place_b = np.repeat(starts_b[low:high][of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys = (a[place_a] << (_ID + _DOC)) | (b[place_b] << _DOC) | np.repeat(doc[low:high][of], n)
        parts.append(np.unique(keys, return_counts=True))
    return _added(parts)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _postings(first: int, keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each side id of a batch."""
    if not len(keys):
        return
    pairs = keys >> _DOC
    pair_at = np.append(np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])), len(keys))
    pair = pairs[pair_at[:-1]]
    sides = pair >> _ID
    side_at = np.append(np.flatnonzero(np.append(True, sides[1:] != sides[:-1])), len(sides))
    n = len(side_at) - 1
    columns = {
        "a": pa.array(sides[side_at[:-1]], pa.int32()), "first": pa.array(np.full(n, first)),
        "b": _lists(pair & ((1 << _ID) - 1), side_at), "n": _lists(np.diff(pair_at), side_at),
        "docs": _binaries((keys & ((1 << _DOC) - 1)).astype("<u2"), pair_at[side_at]), "times": _binaries(times.astype("<u4"), pair_at[side_at]),
    }
    yield _batch(columns, n)


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    kinds = {"groups_sha256": pa.string(), "a": pa.int32(), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "docs": pa.binary(), "times": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, kinds.get(x, pa.int64())) for x in _NAMES], names=_NAMES)


def _aligner(files) -> Callable:
    """A row for each document of (row, doc_id, text), and the postings of each batch."""

    def flush(docs: list[tuple], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = dict(zip(_NAMES, map(list, zip(*docs))))
        yield _batch({x: pa.array(v, pa.string() if x == "groups_sha256" else pa.int64()) for x, v in columns.items()}, len(docs))
        if held:
            a, b, in_a, in_b, doc = (np.concatenate(x) for x in zip(*held))
            yield from _postings(docs[0][0], *link_counts(a, b, in_a, in_b, doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, docs, held, size = Sides(*files.value), [], [], 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                found = sides.encode(text)
                if not found:
                    docs.append((row, doc_id, 0, 0, 0, 0, ""))
                else:
                    a, b = found
                    ga, gb = sides.groups(a, b)
                    in_a, in_b = np.bincount(ga), np.bincount(gb)
                    docs.append((row, doc_id, len(a), len(b), len(in_a), int((in_a * in_b).sum()), sides.digest(a, b, ga, gb, in_a, in_b)))
                    held.append((a, b, in_a, in_b, np.full(len(in_a), row - docs[0][0])))
                    size += len(text)
                if size >= BATCH_BYTES or row - docs[0][0] >= BATCH_DOCS - 1:
                    yield from flush(docs, held)
                    docs, held, size = [], [], 0
        if docs:
            yield from flush(docs, held)

    return run


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What postings add to documents, packed by the batch that holds these; the counts of a side id come before its
    postings."""
    partners = counts = best = None
    held, firsts, size = [], set(), 0

    def out() -> pa.RecordBatch:
        rows, times, good, counted = (np.concatenate(x) for x in zip(*held))
        row, at = np.unique(rows, return_inverse=True)
        n_best, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        np.add.at(n_best, at, times * good)
        np.add.at(total, at, times * counted)
        first = np.array(sorted(firsts))
        edges = np.append(np.searchsorted(row, first), len(row))  # batches are ranges of rows, apart from one another
        docs = (row - np.repeat(first, np.diff(edges))).astype("<u2")
        return pa.RecordBatch.from_arrays([pa.array(first), *(_binaries(x, edges) for x in (docs, n_best, total))], names=["first", "docs", "n_best", "count_sum"])

    for batch in batches:
        first = batch.column("first").to_pylist()
        lists = [(x.offsets.to_numpy(), x.flatten().to_numpy(), int(x.offsets[0].as_py()) if len(x) else 0) for x in (batch.column("b"), batch.column("n"))]
        totals = batch.column("total")
        for k, at in enumerate(first):
            b, n = (values[offsets[k] - base : offsets[k + 1] - base] for offsets, values, base in lists)
            if at is None:
                total = totals[k].values.to_numpy()
                order = np.argsort(b)
                partners, counts, best = b[order], total[order], total.max()
                continue
            docs, times = (np.frombuffer(batch.column(x)[k].as_buffer(), kind).astype(np.int64) for x, kind in (("docs", "<u2"), ("times", "<u4")))
            counted = np.repeat(counts[np.searchsorted(partners, b)], n)
            held.append((at + docs, times, counted == best, counted))
            firsts.add(at)
            size += len(docs)
            if size >= POSTINGS:
                yield out()
                held, firsts, size = [], set(), 0
    if held:
        yield out()


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) of contributions that come a batch of documents after another."""
    first, sums = None, np.zeros((2, BATCH_DOCS), np.int64)

    def out() -> pa.RecordBatch:
        row = np.flatnonzero(sums[1])  # a document with a link counts at least 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (first + row, sums[0, row], sums[1, row])], names=["row", "n_best", "count_sum"])

    for batch in batches:
        for k, at in enumerate(batch.column("first").to_pylist()):
            if at != first:
                if first is not None:
                    yield out()
                first, sums = at, np.zeros((2, BATCH_DOCS), np.int64)
            docs, n_best, total = (np.frombuffer(batch.column(x)[k].as_buffer(), kind) for x, kind in (("docs", "<u2"), ("n_best", "<i8"), ("count_sum", "<i8")))
            sums[0, docs] += n_best
            sums[1, docs] += total
    if first is not None:
        yield out()


def align(documents: DataFrame, tokenizers: str = "/opt/tokenizers", byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a row of ``documents``: how many tokens
    each side has, the groups and links, the links whose pair is linked in the most documents of all pairs of its side id, and
    the sum over links of the documents that hold the pair.

    ``byte_level`` is a byte-level BPE in JSON, ``pieces`` a sentencepiece model; the driver reads both from ``tokenizers``
    and sends them out. Texts that are null or empty, or that a side doesn't give back byte for byte, have no tokens. Repeated
    rows are documents of their own, whatever their ids, and a null id stays; other columns are ignored. One text must fit a
    task. Of an empty table the result is empty.
    """
    spark, found = documents.sparkSession, []
    for name in (byte_level, pieces):
        with open(f"{tokenizers}/{name}", "rb") as f:
            found.append(f.read(MOST_VOCABULARY + 1))
        if len(found[-1]) > MOST_VOCABULARY:
            raise ValueError(f"{name} has over {MOST_VOCABULARY} bytes")
    files = spark.sparkContext.broadcast(tuple(found))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    aligned = write_table(rows.mapInArrow(_aligner(files), _SCHEMA), "aligned")
    posts = aligned.filter("a IS NOT NULL").select("a", "first", "b", "n", "docs", "times")

    pair = posts.select("a", F.explode(F.arrays_zip("b", "n")).alias("p")).groupBy("a", "p.b").agg(F.sum("p.n").alias("total"))
    counts = write_table(pair.groupBy("a").agg(F.sum("total").alias("size"), F.collect_list(F.struct("b", "total")).alias("p")), "counts")  # a list is no longer than the vocabulary
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(documents) / PART_BYTES))
    whole = counts.agg(F.sum("size")).first()[0] or 1
    slices = counts.select("a", "p", F.expr(f"CAST(1 + size * {SLICES * parts} / {whole} AS INT)").alias("slices"))
    heads = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("first"), F.col("p.b").alias("b"), F.lit(None).cast("array<int>").alias("n"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"), F.col("p.total").alias("total"))
    many = F.broadcast(slices.filter("slices > 1").select("a", "slices"))  # a row a side id at most
    dealt = posts.join(many, "a", "left").select("a", F.pmod(F.xxhash64("first"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"), "first", "b", "n", "docs", "times", F.lit(None).cast("array<long>").alias("total"))
    streams = heads.unionByName(dealt).repartition(parts, "a", "slice").sortWithinPartitions("a", "slice", F.asc_nulls_first("first"))
    added = streams.mapInArrow(_contributions, "first long, docs binary, n_best binary, count_sum binary")
    sums = added.repartition(parts, "first").sortWithinPartitions("first").mapInArrow(_document_sums, "row long, n_best long, count_sum long")
    docs = aligned.filter("row IS NOT NULL").select(*_NAMES[:7])
    return docs.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
