"""Vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a / |a|; a zero vector as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def summed(df: DataFrame, keys: list[str], vector: str, how: str = "sum") -> DataFrame:
    """Elementwise sum or mean by key, as partial aggregates over positions."""
    each = df.select(*keys, F.posexplode(vector).alias("_at", "_x"))
    sums = each.groupBy(*keys, "_at").agg((F.sum if how == "sum" else F.avg)("_x").alias("_x"))
    return sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_v")).select(*keys, F.col("_v._x").alias(vector))
