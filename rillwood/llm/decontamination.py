"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window (10 consecutive words, or a shorter item whole) can occur in a document only if each of its words does,
so with containment of 1 one word of it, its prefix, is enough to find all candidates. Words are ordered by rarity over all
documents and the rarest is the prefix; a document word that equals it fixes where the window would have to start, which the
positional and length bounds test before the words themselves are compared.

A benchmark of a few MB is broadcast with its windows, and documents don't move. Of a larger one only the prefix words are
sent out; the places in documents where one stands travel with the words around them and meet the windows in a shuffled join.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, write_table

#: Bytes of benchmark text whose windows are broadcast at most, which takes about 85 times as much on the driver and in each
#: worker; bytes of prefix words that are sent out at a time for a larger benchmark.
BLOCK_BYTES, PREFIX_BYTES = 3_000_000, 16_000_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of 0-9, a-z and whatever isn't ASCII, after lower-casing A-Z."""
    return text.translate(_TABLE).split() if text else []


def windows_of(items: list[tuple[str | None, bytes]], size: int) -> dict[tuple[bytes, ...], set[str]]:
    """Windows of item words -> the items that have them; an item without an id adds none."""
    out: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out[tuple(w[i : i + size])].update([] if item is None else [item])
    return out


def prefix_index(windows: dict[tuple[bytes, ...], set[str]], rarity: dict[bytes, int]) -> dict[bytes, list[tuple[int, list[bytes], list[str]]]]:
    """Rarest word of each window -> (its place in the window, the window, items)."""
    out: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = defaultdict(list)
    for w, items in windows.items():
        k = min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i))
        out[w[k]].append((k, list(w), sorted(items)))
    return dict(out)


def occurrences(words: list[bytes], index: dict[bytes, list[tuple[int, list[bytes], list[str]]]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans of all windows that occur, and their items."""
    spans, items, n = [], set(), len(words)
    for i in [i for i, w in enumerate(words) if w in index]:
        for k, window, of in index[words[i]]:
            start = i - k
            if start >= 0 and start + len(window) <= n and words[start : start + len(window)] == window:
                spans.append((start, start + len(window)))
                items.update(of)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")


def _rarity(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that have each word of the vocabulary, counted over all documents."""
    seen = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = seen.value, Counter()
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                total.update(have.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n"))
    out = {bytes(r[0]): r[1] for r in counted.collect()}  # a row for each word of one block at most
    seen.unpersist()
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES, prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged [start, end) word spans, flat) and ``hit_items`` (sorted item ids as
    strings): every occurrence of every benchmark window. Columns of these names are replaced; all others pass through.

    A benchmark of up to ``block_bytes`` is broadcast and held against all documents in one pass without a shuffle. For a
    larger one documents are read once for the words' rarity and once for each ``prefix_bytes`` of prefix words, a benchmark
    of some 100 MB once; both ways find the same.
    Null text has no words; items without words are never found; those with a null id give spans and no item; repeated items
    share their windows; an empty benchmark hits nothing; an empty table gives an empty result. One text must fit a task,
    however long it is.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    items = _items(benchmark, item_col, item_text)
    if (items.agg(F.sum(F.length("text") + 64)).first()[0] or 0) <= block_bytes:
        return _by_broadcast(docs, [(r[0], bytes(r[1])) for r in items.collect()], text_col, size)  # at most block_bytes
    return _by_join(docs, items, text_col, size, prefix_bytes)


def _by_broadcast(docs: DataFrame, items: list[tuple[str | None, bytes]], text_col: str, size: int) -> DataFrame:
    (raw,) = free_name(docs, "raw_text")
    n_docs, windows = len(docs.columns), windows_of(items, size)
    rarity = _rarity(docs.select(F.col(text_col).cast("string").alias("text")), {w for window in windows for w in window}) if windows else {}
    index = docs.sparkSession.sparkContext.broadcast(prefix_index(windows, rarity))
    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")}).schema

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for b in batches:
            n_words, spans, found = [], [], []
            for t in b.column(n_docs).cast(pa.large_binary()):
                w = words_of(t.as_py())
                s, i = occurrences(w, held)
                n_words.append(len(w))
                spans.append([x for ab in merged(s) for x in ab])
                found.append(sorted(i))
            yield pa.RecordBatch.from_arrays([*b.columns[:n_docs], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return docs.withColumn(raw, F.col(text_col).cast("string")).mapInArrow(hits, schema)


def _item_windows(items: DataFrame, size: int) -> DataFrame:
    """(win, words, items): each window once, with the items that have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [list(w) for w in windows_of([(item, text)], size)]
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(w) for w in found], pa.binary()), pa.array(found, pa.list_(pa.binary())), pa.array([item] * len(found), pa.string())], names=["win", "words", "item"])

    return items.mapInArrow(cut, "win binary, words array<binary>, item string").groupBy("win").agg(F.first("words").alias("words"), F.collect_set("item").alias("items"))


def _word_documents(texts: DataFrame) -> DataFrame:
    """(word, n): documents that have each word, of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = Counter(w for t in b.column(0).cast(pa.large_binary()) for w in set(words_of(t.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(texts: DataFrame, prefixes: set[bytes], size: int) -> DataFrame:
    """(prefix, row, place, before, around): where prefix words stand in documents (row, text), with up to size - 1 words on
    either side, ``before`` of them in front."""
    sent = texts.sparkSession.sparkContext.broadcast(prefixes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                w = words_of(t.as_py())
                at = [i for i, x in enumerate(w) if x in have]
                low = [max(0, i - size + 1) for i in at]
                columns = [pa.array([w[i] for i in at], pa.binary()), pa.array([row] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array([i - k for i, k in zip(at, low)], pa.int32()), pa.array([w[k : i + size] for i, k in zip(at, low)], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["prefix", "row", "place", "before", "around"])

    return texts.mapInArrow(find, "prefix binary, row long, place int, before int, around array<binary>")


def _by_join(docs: DataFrame, items: DataFrame, text_col: str, size: int, prefix_bytes: int) -> DataFrame:
    row, raw = free_name(docs, "row", "raw_text")
    held = write_table(docs.withColumns({row: F.monotonically_increasing_id(), raw: F.col(text_col).cast("string")}), "numbered")
    texts = held.select(F.col(row).alias("row"), F.col(raw).alias("text"))
    windows = write_table(_item_windows(items, size), "windows")
    words = windows.select("win", F.posexplode("words").alias("k", "word"))
    # the rarest word of each window; joined by the word, whose rows of a very common one can be split
    seen = _word_documents(texts.select("text")).join(words.select("word").distinct(), "word", "left_semi")
    ranked = words.join(write_table(seen, "rarity"), "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word").alias("prefix"), "k")).alias("p"))
    known = write_table(windows.join(ranked.filter("p.n > 0"), "win").select("p.prefix", "p.k", "words", "items"), "prefixed")
    prefixes = write_table(known.select("prefix").distinct(), "prefixes")
    n = (prefixes.agg(F.sum(F.length("prefix") + 64)).first()[0] or 0) // prefix_bytes + 1
    found = []
    for part in range(n):
        some = {bytes(r[0]) for r in prefixes.filter(F.pmod(F.xxhash64("prefix"), F.lit(n)) == part).toLocalIterator()}  # about prefix_bytes
        places = write_table(_places(texts, some, size), "places") if some else None
        if places is not None:
            start = F.col("before") - F.col("k")
            same = places.join(known, "prefix").filter((start >= 0) & (F.slice("around", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")))
            found.append(same.select("row", (F.col("place") - F.col("k")).alias("a"), (F.col("place") - F.col("k") + F.size("words")).alias("b"), "items"))
    spans = held.sparkSession.createDataFrame([], "row long, hit_spans array<int>, hit_items array<string>")
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        grouped = every.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))

        def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat = [[x for ab in merged([(s["a"], s["b"]) for s in of]) for x in ab] for of in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.list_(pa.int32())), b.column(2)], names=["row", "hit_spans", "hit_items"])

        spans = grouped.mapInArrow(join_spans, "row long, hit_spans array<int>, hit_items array<string>")
    n_words = F.regexp_count(F.translate(F.coalesce(F.col(raw), F.lit("")), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    out = held.withColumn("n_words", n_words.cast("long")).join(spans.withColumnRenamed("row", row), row, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(*docs.columns, "n_words", none("hit_spans", "array<int>"), none("hit_items", "array<string>"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    n_hit = F.expr("aggregate(hit_spans, 0L, (a, x) -> x - a)")  # start, end, start, end: each step flips the sign of all before it
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))



#: DuckDB SQL for contamination_report().
CONTAMINATION_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(ws)) AS size, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS win
       FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, k, array_to_string(ws[k : k + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM w, sizes WHERE len(ws) >= size)),
m AS (SELECT doc_id, k, size, item FROM dw JOIN iw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id
"""
