"""Exact order statistics of a column by narrowing histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of one pass, and so the rows that come back from it.
BINS = 4096


def order_statistic(values: DataFrame, column: str, rank: int) -> tuple[float, int]:
    """The value of 0-based rank among the finite values of a column, and how many values are at most that.

    Each pass counts BINS bins between the least and the greatest value left
    and keeps the bin that holds the rank, with its own least and greatest
    value; every pass splits off at least one value, in practice three passes
    reach a bin of equal values. A task hands on at most BINS rows.
    """
    x = F.col(column).cast("double")
    low, high, n = values.agg(F.min(x), F.max(x), F.count(x)).first()
    if not 0 <= rank < n:
        raise IndexError(f"rank {rank} of {n} values")
    before = 0
    while low < high:
        inside = values.where(x.between(F.lit(low), F.lit(high)))
        bins = inside.groupBy(_bin(x, low, high).alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect()
        for own in sorted(bins, key=lambda r: r["bin"]):
            if before + own["n"] > rank:
                low, high, n = own["low"], own["high"], own["n"]
                break
            before += own["n"]
    return low, before + n


def _bin(x: Column, low: float, high: float) -> Column:
    """0 ... BINS - 1, rising with x; halves keep the span of any two doubles finite."""
    half = 0.5 if math.isinf(high - low) else 1.0
    share = (x * half - low * half) / F.lit(high * half - low * half)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def quantile(values: DataFrame, column: str, q: float) -> float | None:
    """The q-quantile (0 to 1) with linear interpolation between the two nearest values; null, NaN and infinite values don't count, None if no other is left.

    values is read a few times: a written table.
    """
    x = F.col(column).cast("double")
    finite = values.select(x.alias(column)).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = finite.count()
    if not n:
        return None
    place = q * (n - 1)
    rank = min(math.floor(place), n - 1)
    low, at_most = order_statistic(finite, column, rank)
    part = place - rank
    if not part or at_most > rank + 1:
        return low
    high = finite.where(x > F.lit(low)).agg(F.min(x)).first()[0]
    return low + (high - low) * part
