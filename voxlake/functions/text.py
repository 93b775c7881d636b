"""Text and clock expressions. All are native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlake import fixed

# Unicode white space, spelled out because Java's and RE2's \s are ASCII.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
SENTENCE_END = r"(?<=[.!?])" + SPACE + "+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """White-space separated words; empty array for blank text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalise(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscore becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def clock(seconds: Column) -> Column:
    """Seconds to HH:MM:SS, fractions dropped."""
    s = seconds.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    )


def short_clock(seconds: Column) -> Column:
    """Seconds to MM:SS, or H:MM:SS from one hour on; 00:00 for missing or negative input."""
    s = F.floor(seconds).cast("bigint")
    minutes = F.floor((s % 3600) / 60)
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < F.lit(float("inf")))
    return (
        F.when(~usable | seconds.isNull(), F.lit("00:00"))
        .when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), minutes, s % 60))
        .otherwise(F.format_string("%02d:%02d", minutes, s % 60))
    )


def clock_seconds(stamp: Column) -> Column:
    """HH:MM:SS or MM:SS back to seconds; 0 when a part is not a number."""
    parts = F.transform(F.split(stamp, ":"), lambda p: F.when(F.trim(p) == "", 0.0).otherwise(F.trim(p).try_cast("double")))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.coalesce(total, F.lit(0.0))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def date_time(ts: Column) -> Column:
    """`2 Jun 2020, 01:04`; the session zone must be UTC."""
    return F.date_format(ts, "d MMM yyyy, HH:mm")


def date_only(ts: Column) -> Column:
    return F.date_format(ts, "d MMM yyyy")


def ordinal(n: Column) -> Column:
    suffix = (
        F.when((n % 100).between(10, 20), F.lit("th"))
        .when(n % 10 == 1, F.lit("st"))
        .when(n % 10 == 2, F.lit("nd"))
        .when(n % 10 == 3, F.lit("rd"))
        .otherwise(F.lit("th"))
    )
    return F.concat(n.cast("string"), suffix)


def is_substantive(text: Column) -> Column:
    """Can this turn carry a change of mood at all?"""
    t = strip(text)
    return (
        (t != "")
        & ~t.rlike(fixed.PLEASANTRY)
        & ~t.rlike(fixed.DICTATION)
        & (word_count(text) >= fixed.MIN_PROSODY_WORDS)
    )


def is_citable(speaker: Column, text: Column) -> Column:
    """A customer turn long enough to be quoted."""
    return (speaker == "customer") & (word_count(normalise(text)) >= fixed.MIN_QUOTE_WORDS)
