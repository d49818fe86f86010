"""Columns of text, hashes, dates and vectors."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillwood.functions import arrays as A
from rillwood.functions import dates as D
from rillwood.functions import hashing as H
from rillwood.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_md5_int(spark):
    assert one(spark, H.md5_int(F.lit("abc"))) == 2416005272


def test_buckets_stay_in_range(spark):
    got = {r[0] for r in spark.range(500).select(H.hashed_bucket(F.col("id"), 11)).collect()}
    assert got == set(range(1, 12))
    assert one(spark, H.hashed_bucket(F.lit(None).cast("string"))) is None


def test_poisson_weights_have_mean_one(spark):
    mean, zero = spark.range(20_000).select(H.poisson_weight(F.col("id"), F.lit(3)).alias("w")).agg(F.avg("w"), F.avg((F.col("w") == 0).cast("int"))).first()
    assert abs(mean - 1) < 0.03 and abs(zero - math.exp(-1)) < 0.02


@pytest.mark.parametrize(("text", "words"), [(None, []), ("", []), ("...", []), ("Ab, c1d É!", ["ab", "c", "d", "é"])])
def test_clean_words(spark, text, words):
    assert one(spark, X.clean_words(F.lit(text).cast("string"))) == words


def test_ngrams(spark):
    words = F.array(*[F.lit(w) for w in "abc"])
    assert one(spark, X.word_ngrams(words, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, X.word_ngrams(F.array(F.lit("a")), 3)) == ["a"]


def test_vectors(spark):
    a = F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))
    assert one(spark, A.total(a)) == 4.0 and one(spark, A.non_zero(a)) == 2 and one(spark, A.argmax(a)) == 2
    assert one(spark, A.argmax(F.array().cast("array<double>"))) == -1
    assert one(spark, A.plus(a, F.array(F.lit(1.0)))) == [2.0, 0.0, 3.0]
    assert one(spark, A.entropy(F.array(F.lit(5), F.lit(5)))) == 1.0
    assert one(spark, A.decremented(a, 2)) == [1.0, 0.0, 2.0]
    assert [tuple(x) for x in one(spark, A.non_zero_entries(a))] == [(0, 1.0), (2, 3.0)]
    m = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    assert one(spark, A.map_argmax(m)) == "y" and one(spark, A.merged_counts(m, m)) == {"x": 2, "y": 4}


NOW = "2024-02-29 12:00:00"


@pytest.mark.parametrize(("text", "at"), [("next year", datetime(2025, 2, 28, 12)), ("-1 day 2 hours", datetime(2024, 2, 28, 10)), ("12 am", datetime(2024, 2, 29)), ("25:00", None), ("", None)])
def test_dates_in_words(spark, text, at):
    assert one(spark, D.parse_date(F.lit(text), F.lit(NOW).cast("timestamp"))) == at


def test_strict_dates_raise(spark):
    with pytest.raises(Exception, match="not a date"):
        one(spark, D.parse_date_strict(F.lit("whenever"), F.lit(NOW).cast("timestamp")))


def test_clock_times_have_zones(spark):
    now = F.lit(NOW).cast("timestamp")
    wanted = {"10:30 -0500": (29, 15), "10:30 est": (29, 15), "10:30 +02:00": (29, 8), "10:30 gmt": (29, 10), "11:30 am pdt": (29, 18), "10:30": (29, 10)}
    for text, (day, hour) in wanted.items():
        assert one(spark, D.parse_date(F.lit(text), now)) == datetime(2024, 2, day, hour, 30)
    assert one(spark, D.parse_date(F.lit("10:30 pm pst"), now)) == datetime(2024, 3, 1, 6, 30)
    assert one(spark, D.parse_date(F.lit("10:30 +99:00"), now)) is None
    assert one(spark, D.epoch_millis(F.lit("1970-01-01 00:00:01"))) == 1000


def test_long_grams_are_those_of_a_loop(spark):
    words = ["a", "bb", "a", "c.d", "é", "$1"]
    want = words + [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
    assert one(spark, X.word_ngrams(F.array(*map(F.lit, words)), 3)) == want
    assert one(spark, X.word_ngrams(F.array(F.lit("a")), 3)) == ["a"]


def test_running_shares_go_on_over_blocks(spark, monkeypatch):
    texts = [(i, "all " + ("odd" if i % 2 else "even even")) for i in range(1, 40)]
    df = spark.createDataFrame(texts, "id long, text string")
    whole = {(r["id"], r["term"]): r["df"] for r in X.tfidf_running(df, "id", "text").collect()}
    monkeypatch.setattr(X, "BLOCK", 7)
    cut = {(r["id"], r["term"]): r["df"] for r in X.tfidf_running(df, "id", "text").collect()}
    assert cut == whole and len(cut) == 78
    assert cut[39, "all"] == 1.0 and cut[39, "odd"] == 20 / 39 and cut[38, "even"] == 19 / 38


def test_murmur_is_that_of_the_engine(spark):
    assert one(spark, H.murmur(F.lit("x"))) == one(spark, F.hash(F.lit("x")))


# what texts say at 2024-03-14 09:26:53, a Thursday
DATES = {
    "now": "2024-03-14 09:26:53", "today": "2024-03-14 00:00:00", "Midnight": "2024-03-14 00:00:00", "noon": "2024-03-14 12:00:00", "tonight": "2024-03-14 20:00:00",
    "tomorrow": "2024-03-15 00:00:00", "tomorrow morning": "2024-03-15 07:00:00", "yesterday evening": "2024-03-13 17:00:00", "tomorrow at 3:15 pm": "2024-03-15 15:15:00", "yesterday 8 am": "2024-03-13 08:00:00",
    "12:00 am": "2024-03-14 00:00:00", "12:30pm": "2024-03-14 12:30:00", "23:59:58": "2024-03-14 23:59:58", "Oct 26, 1981": "1981-10-26 00:00:00", "26 October 1981": "1981-10-26 00:00:00", "October 26, 1981 14:05": "1981-10-26 14:05:00",
    "10/26/1981": "1981-10-26 00:00:00", "10-26-1981": "1981-10-26 00:00:00", "1981/10/26": "1981-10-26 00:00:00", "1981-10-26 01:02:03": "1981-10-26 01:02:03", "10/26": "2024-10-26 00:00:00",
    "October": "2024-10-01 00:00:00", "monday": "2024-03-18 00:00:00", "Thursday": "2024-03-21 00:00:00", "next friday": "2024-03-15 00:00:00", "last friday": "2024-03-08 00:00:00", "next week": "2024-03-21 09:26:53", "last month": "2024-02-14 09:26:53",
    "next year": "2025-03-14 09:26:53", "last january": "2024-01-01 00:00:00", "next january": "2025-01-01 00:00:00", "+1 week 2 days": "2024-03-23 09:26:53", "-3 hours": "2024-03-14 06:26:53", "2 months ago": "2024-01-14 09:26:53", "13:75": None, "no date": None,
}


def test_dates_in_words(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "input string")
    got = rows.select("input", D.formatted(D.parse_date(F.col("input"), F.lit("2024-03-14 09:26:53").cast("timestamp"))).alias("parsed")).collect()
    assert {r.input: r.parsed for r in got} == DATES
