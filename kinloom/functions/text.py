"""Text columns: stripping, tags, keys, JSON-safe numbers, progress."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters of rich tags in order, and words they drop.
DELIMITERS = ("|", ",", ";", "\n", " and ", " & ")
STOP_WORDS = ("the", "and", "or", "in", "at", "of", "to", "for")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any alphabet."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tags(text: Column, separator: str = "|") -> Column:
    """Stripped non-empty parts; null has none."""
    parts = F.transform(F.split(text, re.escape(separator)), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def rich_tags(text: Column, most: int = 10) -> Column:
    """Parts by all delimiters in turn, lower-cased, longer than two characters, without stop words, the first `most`."""

    def cut(delimiter: str):
        return lambda x: F.transform(F.split(x, r"\Q" + delimiter + r"\E"), strip)

    parts = F.array(text)
    for d in DELIMITERS:
        parts = F.filter(F.flatten(F.transform(parts, cut(d))), lambda x: x != "")
    parts = F.filter(F.transform(parts, F.lower), lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))
    return F.coalesce(F.slice(parts, 1, most), F.array().cast("array<string>"))


def progress(message: Column) -> Column:
    """`Step a/b` as a percentage, `x%` as x, anything else 0; clamped to 0..100."""
    a = F.regexp_extract(message, r"Step (\d+)/(\d+)", 1)
    b = F.regexp_extract(message, r"Step (\d+)/(\d+)", 2)
    p = F.regexp_extract(message, r"(\d+(?:\.\d+)?)%", 1)
    found = F.when(a != "", F.coalesce(F.try_divide(a.cast("double") * 100, b.cast("double")), F.lit(0.0))).when(p != "", p.try_cast("double")).otherwise(0.0)
    return clamp(F.coalesce(found, F.lit(0.0)), 0.0, 100.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def content_key(text: Column) -> Column:
    return F.md5(text)


def row_key(columns: list[str]) -> Column:
    """md5 of the columns as JSON, in order of name."""
    return F.md5(F.to_json(F.struct(*sorted(columns))))


def comparison_key(target: Column, others: Column) -> Column:
    """Eight hex digits of the target and eight of its sorted set of comparisons."""
    return F.concat_ws("_", F.substring(F.md5(target), 1, 8), F.substring(F.md5(F.array_join(F.array_sort(F.array_distinct(others)), "|")), 1, 8))


def csv_name(name: Column) -> Column:
    return F.lower(name).endswith(".csv")
