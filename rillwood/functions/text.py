"""Words, n-grams and hashed text features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwood.sources.work import written

from .hashing import hashed_bucket


def clean_words(col: Column) -> Column:
    """Lower-cased runs of letters; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}]+"), "")


def word_ngrams(words: Column, longest: int = 2) -> Column:
    """All runs of 1 to ``longest`` words, shorter ones first, joined by a space; words hold no space themselves."""
    line, word = F.array_join(words, " "), "[^ ]++"
    # an empty match at the start of each word looks ahead at the run: no lambda a word, so this stays in generated code
    runs = lambda n: F.regexp_extract_all(line, F.lit(f"(?<![^ ])(?=({' '.join([word] * n)}))"), 1)
    return F.concat(words, *[runs(n) for n in range(2, longest + 1)])


def hashed_ngrams(df: DataFrame, key: str, text: str, longest: int = 2, probes: int = 2, buckets: int = 15) -> DataFrame:
    """(key, feature, gram): each n-gram of texts of more than one word at its hashed places; of several grams at one place
    the last by name stays."""
    words = df.select(key, clean_words(F.col(text)).alias("words")).filter(F.size("words") > 1)
    grams = words.select(key, F.explode(F.array_distinct(word_ngrams(F.col("words"), longest))).alias("gram"))
    placed = grams.select(key, "gram", F.explode(F.array(*[hashed_bucket(F.col("gram"), buckets, p) - 1 for p in range(probes)])).alias("feature"))
    return placed.groupBy(key, "feature").agg(F.max("gram").alias("gram"))


def term_counts(df: DataFrame, key: str, text: str, shortest: int = 1) -> DataFrame:
    """(key, term, tf)"""
    # null terms, of which there are none, are left out here: a join would push that filter into one of its sides, and the
    # two could no longer share this shuffle
    # texts are dealt by key, so the counts are made where they lie: a text is a few times smaller than its rows of terms
    texts = df.select(key, text).repartition(key)
    terms = texts.select(key, F.explode(clean_words(F.col(text))).alias("term")).filter(F.col("term").isNotNull() & (F.length("term") >= shortest))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _weighed(counts: DataFrame, df_share: Column, log_tf: bool, binary: bool, low: float, high: float) -> DataFrame:
    tf = F.lit(1.0) if binary else 1 + F.log("tf") if log_tf else F.col("tf").cast("double")
    out = counts.withColumn("df", df_share).filter((F.col("df") >= low) & (F.col("df") <= high))
    return out.withColumn("weight", tf * (1 + F.log(1 / F.col("df"))))


#: Documents a block of running shares.
BLOCK = 1 << 16


def _documents() -> Column:
    """Documents of a group of counts. It asks for ``tf``, so that nothing is pruned and the counts are made once."""
    return F.count_if(F.col("tf") > 0)


def _by_term(counts: DataFrame, sums: DataFrame, *by: str) -> DataFrame:
    """``counts`` with the sums of their terms. The length is a second key, by which neither side is dealt yet: both are
    shuffled for the join alone, and the rows of a very common term are split."""
    size = F.length("term")
    return counts.withColumn("_size", size).join(sums.withColumn("_size", size), ["term", *by, "_size"]).drop("_size")


def tfidf_batch(df: DataFrame, key: str, text: str, log_tf: bool = True, binary: bool = False, min_df: float = 0.0, max_df: float = 1.0, shortest: int = 1) -> DataFrame:
    """(key, term, tf, df, weight) with document shares over the whole table: weight = tf' * (1 + ln(1 / df))."""
    counts, n = term_counts(df, key, text, shortest), df.agg(F.count(F.lit(1)).alias("n_docs"))
    shares = counts.groupBy("term").agg(_documents().alias("n_with"))
    if min_df > 0:  # a document has few of the terms of a least share: there are no more than its mean number by min_df
        total = n.first()[0]
        kept = written(shares.filter((F.col("n_with") / total >= min_df) & (F.col("n_with") / total <= max_df)), "shares")
        joined = counts.join(kept, "term").withColumn("n_docs", F.lit(total))  # a small table is sent out, as its files' size says
        return _weighed(joined, F.col("n_with") / F.col("n_docs"), log_tf, binary, min_df, max_df).select(key, "term", "tf", "df", "weight")
    joined = _by_term(counts, shares).crossJoin(F.broadcast(n))  # one row
    return _weighed(joined, F.col("n_with") / F.col("n_docs"), log_tf, binary, min_df, max_df).select(key, "term", "tf", "df", "weight")


def tfidf_running(df: DataFrame, key: str, text: str, log_tf: bool = True, binary: bool = False) -> DataFrame:
    """As ``tfidf_batch``, with the shares as they stood when each document came, itself included; documents come in the
    order of ``key``, whole numbers from 0 or 1 without gaps being their own count.

    Documents are counted in blocks, so a term's rows of one block at most are in one place, and one row a block is.
    """
    from rillwood.operators.ordering import numbered

    place = numbered(df.select(key), key, "seen")
    counts = term_counts(df, key, text).join(place, key).withColumn("block", F.floor(F.col("seen") / BLOCK))
    before = W.partitionBy("term").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n_in")).withColumn("n", F.sum("n_in").over(before)).filter("n > 0")
    # what lies before a block leads its rows, so they are shuffled once and joined with nothing
    kind = counts.schema[key].dataType
    heads = starts.select("term", "block", F.lit(None).cast(kind).alias(key), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("tf"), "n")
    rows = heads.unionByName(counts.select("term", "block", key, "seen", "tf", F.lit(1).cast("long").alias("n")))
    so_far = W.partitionBy("term", "block").orderBy("seen").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("with", F.sum("n").over(so_far)).filter("tf > 0")
    return _weighed(found, F.col("with") / F.col("seen"), log_tf, binary, 0.0, 1.0).select(key, "term", "tf", "df", "weight")


def hashed_tfidf(weights: DataFrame, key: str, probes: int = 2, buckets: int = 100) -> DataFrame:
    """(key, feature, weight): TF-IDF weights summed at their hashed places."""
    placed = weights.select(key, "weight", F.explode(F.array(*[hashed_bucket(F.col("term"), buckets, p) - 1 for p in range(probes)])).alias("feature"))
    return placed.groupBy(key, "feature").agg(F.sum("weight").alias("weight"))


def hashtags(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"(#\w+)"), 1)


#: Fixed marks of mood.
HAPPY, SAD = [":)", ":-)", ":D", "=)"], [":(", ":-(", "=("]


def emoticon_sentiment(col: Column) -> Column:
    """positive, negative, or null where marks of both moods or none occur."""
    has = lambda marks: F.greatest(*[F.coalesce(F.contains(col, F.lit(m)), F.lit(False)).cast("int") for m in marks]) > 0
    return F.when(has(HAPPY) & ~has(SAD), "positive").when(has(SAD) & ~has(HAPPY), "negative")
