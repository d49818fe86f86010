"""Dates as features, and dates in words. Everything relative is to an explicit ``now``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of absolute dates; each may be followed by a time of day.
DATE_PATTERNS = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyy-M-d"]
TIME_PATTERNS = ["", " H:mm", " H:mm:ss", " H:mm:ss.SSS", " h:mm a"]
#: Fixed hours of words for a time of day.
HOURS = {"midnight": 0, "morning": 7, "noon": 12, "afternoon": 13, "evening": 17, "tonight": 20}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def date_parts(ts: Column, prefix: str, zone: str | None = None) -> list[Column]:
    """Year, month, weekday (1 is Sunday, as a category), day, hour, minute, second, epoch milliseconds and zone offset in
    milliseconds, named by suffix; the minute has a name of its own, ``_mi``."""
    at = ts.cast("timestamp")
    local = F.from_utc_timestamp(at, zone) if zone else at
    offset = (F.unix_millis(local) - F.unix_millis(at)) if zone else F.when(at.isNotNull(), F.lit(0).cast("bigint"))
    parts = {"y": F.year(local), "m": F.month(local), "d": F.dayofweek(local).cast("string"), "dm": F.day(local), "h": F.hour(local), "mi": F.minute(local), "s": F.second(local), "t": F.unix_millis(at), "tzo": offset}
    return [c.alias(f"{prefix}_{k}") for k, c in parts.items()]


def date_by_pattern(text: Column, pattern: str) -> Column:
    """By a pattern; null where the text isn't a date of it."""
    return F.try_to_timestamp(text, F.lit(pattern))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def _got(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, f"^(?:{pattern})$", k)


def _index(names: list[str], word: Column, short: int = 3) -> Column:
    """Place from 1 of a full or shortened name; null for others."""
    out = F.lit(None).cast("int")
    for i, n in enumerate(names, 1):
        out = F.when(word.isin(n, n[:short]), i).otherwise(out)
    return out


def _plus(at: Column, months: Column | int = 0, days: Column | int = 0, seconds: Column | int = 0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return at + F.make_interval(months=lit(months), days=lit(days)) + F.make_dt_interval(secs=lit(seconds).cast("decimal(18,6)"))


#: Fixed offsets of named zones.
ZONES = {"utc": "+00:00", "gmt": "+00:00", "z": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}
_OFFSET = r"[+-](?:0\d|1[0-4]):?[0-5]\d"
_CLOCK = rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d{{1,3}}))?)?\s*(am|pm)?(?:\s*({'|'.join(ZONES)}|{_OFFSET}))?"
_HOUR = r"(\d{1,2})\s*(am|pm)"


def _in_zone(at: Column, zone: Column) -> Column:
    """The time of day ``at`` as one of a named zone or an offset; as it is where there is none."""
    offset = F.when(zone.rlike(f"^{_OFFSET}$"), F.regexp_replace(zone, r"^(...):?(..)$", "$1:$2"))
    for name, by in ZONES.items():
        offset = F.when(zone == name, by).otherwise(offset)
    moved = F.convert_timezone(offset, F.current_timezone(), at.cast("timestamp_ntz")).cast("timestamp")
    return F.when(zone == "", at).otherwise(moved)


def _clock(text: Column, day: Column) -> Column:
    hour = lambda h, half: F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
    num = lambda p, k: F.coalesce(F.nullif(_got(text, p, k), F.lit("")).try_cast("int"), F.lit(0))
    h1, h2 = hour(num(_CLOCK, 1), _got(text, _CLOCK, 5)), hour(num(_HOUR, 1), _got(text, _HOUR, 2))
    millis = F.rpad(F.coalesce(F.nullif(_got(text, _CLOCK, 4), F.lit("")), F.lit("0")), 3, "0").try_cast("int")
    full = F.when((h1 < 24) & (num(_CLOCK, 2) < 60) & (num(_CLOCK, 3) < 60), _plus(day, seconds=h1 * 3600 + num(_CLOCK, 2) * 60 + num(_CLOCK, 3) + millis / 1000))
    return F.when(_has(text, _CLOCK), _in_zone(full, _got(text, _CLOCK, 6))).when(_has(text, _HOUR), F.when(h2 < 24, _plus(day, seconds=h2 * 3600)))


_UNIT = r"([+-]?\s*\d+)\s*(second|sec|minute|min|hour|day|week|fortnight|month|year)s?"
_SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600}
_DAYS = {"day": 1, "week": 7, "fortnight": 14}
_MONTHS = {"month": 1, "year": 12}


def _shift(text: Column, now: Column) -> Column:
    """A sum of signed amounts, as in "+1 week 2 days"; an amount without a sign has that of the one before; "ago" turns
    all around."""
    parts = F.regexp_extract_all(text, F.lit(f"({_UNIT})"), 1)
    amount = lambda p: F.regexp_replace(F.regexp_extract(p, _UNIT, 1), r"\s", "").cast("int")
    signed = F.when(text.rlike(r"^\s*-"), F.transform(parts, lambda p: F.when(F.regexp_extract(p, _UNIT, 1).rlike(r"[+-]"), p).otherwise(F.concat(F.lit("-"), p)))).otherwise(parts)

    def total(units: dict[str, int]) -> Column:
        def one(p: Column) -> Column:
            unit, by = F.regexp_extract(p, _UNIT, 2), F.lit(0)
            for name, size in units.items():
                by = F.when(unit == name, size).otherwise(by)
            return amount(p) * by

        s = F.aggregate(signed, F.lit(0), lambda a, p: a + one(p))
        return F.when(text.rlike(r"ago\s*$"), -s).otherwise(s)

    shifted = _plus(now, total(_MONTHS), total(_DAYS), total(_SECONDS))
    return F.when(text.rlike(rf"^\s*(?:{_UNIT}[\s,]*(?:and)?\s*)+(?:ago)?\s*$"), shifted)


def _next_last(text: Column, today: Column, now: Column) -> Column:
    way, what = F.when(_got(text, r"(next|last)\s+(\w+)", 1) == "next", 1).otherwise(-1), _got(text, r"(next|last)\s+(\w+)", 2)
    wd = _index(WEEKDAYS, what)
    ahead = F.pmod(wd - F.weekday(today) - 2, F.lit(7)) + 1  # 1 to 7 days on
    back = F.pmod(F.weekday(today) - wd, F.lit(7)) + 1
    month = _index(MONTHS, what)
    this = F.make_date(F.year(today), month, F.lit(1)).cast("timestamp")
    first = F.trunc(today, "month").cast("timestamp")
    year = F.when(way > 0, F.when(this > first, 0).otherwise(12)).otherwise(F.when(this < first, 0).otherwise(-12))
    return (
        F.when(what == "week", _plus(now, days=way * 7)).when(what == "month", _plus(now, months=way)).when(what == "year", _plus(now, months=way * 12))
        .when(what == "day", _plus(now, days=way)).when(wd.isNotNull(), _plus(today, days=F.when(way > 0, ahead).otherwise(-back))).when(month.isNotNull(), _plus(this, months=year))
    )


def _worded(text: Column, now: Column) -> Column:
    today = F.date_trunc("day", now)
    out = F.when(text == "now", now).when(text == "today", today)
    for day, by in (("today", 0), ("this", 0), ("tomorrow", 1), ("yesterday", -1)):
        for word, hour in HOURS.items():
            if word != "tonight":
                out = out.when(text == f"{day} {word}", _plus(today, days=by, seconds=hour * 3600))
        rest = F.regexp_replace(text, rf"^{day}\s+(?:at\s+)?", "")
        out = out.when(text == day, _plus(today, days=by)).when(text.rlike(rf"^{day}\s+"), _clock(rest, _plus(today, days=by)))
    for word, hour in HOURS.items():
        out = out.when(text == word, _plus(today, seconds=hour * 3600))
    wd, month = _index(WEEKDAYS, text), _index(MONTHS, text)
    out = out.when(wd.isNotNull(), _plus(today, days=F.pmod(wd - F.weekday(today) - 2, F.lit(7)) + 1))
    return out.when(month.isNotNull(), F.make_date(F.year(today), month, F.lit(1)).cast("timestamp"))


def _absolute(t: Column) -> Column:
    """A date in one of the fixed patterns. Only patterns of the text's shape are tried: a failed try costs an exception."""
    shape, tries = F.regexp_replace(F.regexp_replace(t, r"[0-9]+", "9"), r"\p{L}+", "a"), {}
    for d in DATE_PATTERNS:
        for h in TIME_PATTERNS:
            found = F.try_to_timestamp(F.initcap(t) if "MMM" in d else F.upper(t), F.lit(d + h))
            tries.setdefault(re.sub("[dyHhmsS]+|M{1,2}(?!M)(?<!MMM)", "9", re.sub("M{3,}|a", "a", d + h)), []).append(found)
    out = F.lit(None).cast("timestamp")
    for form, found in tries.items():
        out = F.when(shape == form, F.coalesce(*found)).otherwise(out)
    return out


#: Texts that begin with day, month and year are no words, clocks or sums: they are tried as absolute dates alone.
_DATED = r"^(?:\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|\p{L}+ \d{1,2}, \d{4}|\d{1,2} \p{L}+ \d{4})(?: |$)"


def parse_date(text: Column, now: Column) -> Column:
    """A timestamp from an absolute date, a time of day, or words relative to ``now``; null where nothing fits.

    Tried in turn: now, today, tomorrow and yesterday (with a time of day or a word for one), bare times, dates in the fixed
    patterns, month/day of this year, bare weekdays (the next one) and months (of this year), next and last units, weekdays
    and months, and signed sums of units.
    """
    t = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    today = F.date_trunc("day", now)
    absolute = _absolute(t)
    md = r"(\d{1,2})/(\d{1,2})"
    short = F.when(_has(t, md), F.try_to_timestamp(F.concat_ws("/", F.year(now).cast("string"), t), F.lit("yyyy/M/d")))
    words = F.coalesce(_worded(t, now), _clock(t, today), short, F.when(_has(t, r"(next|last)\s+(\w+)"), _next_last(t, today, now)), _shift(t, now), absolute)
    return F.when(t.rlike(_DATED), absolute).otherwise(words)


def parse_date_strict(text: Column, now: Column) -> Column:
    """As ``parse_date``, but a text that nothing fits raises an error."""
    return F.when(text.isNotNull(), F.coalesce(parse_date(text, now), F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp")))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def formatted(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)
