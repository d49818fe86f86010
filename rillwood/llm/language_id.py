"""Language identification by compression.

Each language has a Zstandard dictionary of raw training text. A whole text is encoded block by block with every dictionary
and belongs to the language whose encoding is the smallest; where the next language comes close the answer is flagged as
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_name

#: Bytes of a language's dictionary at most, of all dictionaries together (so also what is broadcast), of one training
#: passage, and of a block of text that is encoded at a time.
DICT_BYTES, ALL_BYTES, PASSAGE, BLOCK = 96_000, 8_000_000, 600, 2_048
#: Share of the smallest size by which the next must be larger.
MARGIN = 0.01
UNKNOWN = "und"
#: Matches of four bytes, which words of natural text give, over a window that holds the whole dictionary.
_PARAMS = {"window_log": 17, "hash_log": 17, "chain_log": 17, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY}
_LETTER = regex.compile(r"\p{L}")


def train_dictionaries(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: str = "language") -> dict[str, bytes]:
    """Language -> raw dictionary, the languages with most text first, from a bounded sample of the rows with a language that ``held_out`` isn't true for.

    Each language gives about as many passages of ``PASSAGE`` characters as fill its dictionary, of documents chosen by a
    hash of the id and from a place in the text chosen the same way. Every language of the training rows has a dictionary;
    with very many of them each gets a smaller one.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    # a text counts for as many passages as it has room for, so long and short texts are drawn from alike
    room = F.greatest(F.lit(1), F.expr(f"char_length(text) div {PASSAGE}")).cast("long")
    totals = rows.groupBy("lang").agg(F.sum(room).alias("n")).collect()
    size = min(DICT_BYTES, ALL_BYTES // max(1, len(totals)))
    most = max(1, size // PASSAGE) * 3 // 2
    share = F.create_map(*[F.lit(x) for t in totals for x in (t["lang"], min(1.0, most / t["n"]))]) if totals else None
    if share is None:
        return {}
    spot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003))
    chance = F.lit(1.0) - F.pow(F.lit(1.0) - share[F.col("lang")], room)
    taken = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(1_000_003)) < F.ceil(chance * 1_000_003))
    start = (F.expr("char_length(text)") * spot / 1_000_003).cast("int")
    start = F.greatest(F.lit(1), F.least(start, F.expr(f"char_length(text) - {PASSAGE}")))
    passages = taken.select("lang", spot.alias("spot"), "id", F.substring("text", start, F.lit(PASSAGE)).alias("passage"))
    out: dict[str, bytearray] = {}
    for r in passages.orderBy("lang", "spot", "id", "passage").toLocalIterator():
        held = out.setdefault(r["lang"], bytearray())
        if len(held) < size:
            held += r["passage"].encode() + b"\n"
    seen = {t["lang"]: t["n"] for t in totals}
    return {k: bytes(out[k][:size]) for k in sorted(out, key=lambda k: (-seen[k], k))}


class Languages:
    """Encoders by language, made where they are used."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        params = zstandard.ZstdCompressionParameters(**_PARAMS, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.encoders = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, raw: bytes) -> list[int]:
        """Bytes of the whole text with each dictionary, block by block."""
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(e.compress(x)) for x in blocks) for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the score is 0 without a margin over the next language and goes to 1 with it."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text.encode("utf-8", "surrogatepass"))
        best = min(range(len(sizes)), key=lambda k: sizes[k])
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / max(1, sizes[best])
        return self.names[best], margin / (margin + MARGIN) if margin else 0.0, margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (columns of these names are replaced, all others pass
    through), in one pass without a shuffle. Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing was learned; of equal sizes the language with most training text wins. An empty table gives an empty result."""
    docs = docs.drop("lang_pred", "score", "rejected")
    (raw,) = free_name(docs, "raw_text")
    held = docs.withColumn(raw, F.col(text_col).cast("string"))
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(shared.value)
        for b in batches:
            got = [languages.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=schema.names)

    return held.mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document, learned from those that aren't held out."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = identify(docs.select("doc_id", "text"), train_dictionaries(docs, held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
