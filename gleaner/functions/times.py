"""Durations, clock labels and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as tx

CLOCK = r"\b(?:(\d{1,2}):)?([0-5]?\d):([0-5]?\d)\b"


def parse_duration(c: Column) -> Column:
    """Seconds from ``12``, ``12s`` or ``1200ms``; NULL unless positive."""
    value = tx.strip(c.cast("string"))
    is_ms = F.endswith(value, F.lit("ms"))
    number = F.regexp_replace(value, "(?:ms|s)$", "").try_cast("double")
    seconds = F.when(is_ms, F.greatest(number / 1000.0, F.lit(0.0))).otherwise(number)
    return F.when(is_ms | (seconds > 0), seconds)


def clock_label(seconds: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss``."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.format_string("%02d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%02d:%02d", minutes, rest)
    )


def duration_words(seconds: Column) -> Column:
    """Hours, minutes and seconds in words, leaving out zero parts."""
    s = F.greatest(F.lit(0), F.bround(seconds).cast("long"))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    none = F.lit("")
    return F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("小时"))).otherwise(none),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("分"))).otherwise(none),
        F.when((rest > 0) | (s == 0), F.concat(rest.cast("string"), F.lit("秒"))).otherwise(none),
    )


def clock_seconds(c: Column) -> Column:
    """Seconds of one ``[hh:]mm:ss[.mmm]`` caption time."""
    parts = F.split(F.replace(tx.strip(c), F.lit(","), F.lit(".")), ":")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when(F.size(parts).between(2, 3), total)


def max_clock(c: Column) -> Column:
    """Largest clock in a text, in seconds; NULL when there is none above zero."""
    found = F.regexp_extract_all(tx.text_or_empty(c), F.lit(CLOCK), 0)
    seconds = F.transform(found, lambda t: F.aggregate(
        F.transform(F.split(t, ":"), lambda p: p.cast("double")), F.lit(0.0), lambda acc, x: acc * 60 + x
    ))
    top = F.array_max(seconds)
    return F.when(top > 0, top)


def parse_utc(c: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone counts as UTC."""
    value = F.regexp_replace(tx.strip(c), "Z$", "+00:00")
    return F.try_to_timestamp(F.nullif(value, F.lit("")))


def iso_utc(c: Column) -> Column:
    return F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
