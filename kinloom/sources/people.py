"""The people table: CSV scan, missing words, completeness, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.text import strip, tags
from kinloom.schema import COLUMNS, ESSENTIAL, MISSING_WORDS, PEOPLE, SEPARATORS
from kinloom.scratch import dense_id


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A people CSV with all columns as strings; words for missing values become null."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = [c for c in names.columns if c in PEOPLE.fieldNames()]
    return names.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in (known or names.columns)])


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def present(column: Column) -> Column:
    text = strip(column.cast("string"))
    return column.isNotNull() & (text != "") & (text != "nan")


def essentials(df: DataFrame, wanted: tuple[str, ...] = ESSENTIAL) -> tuple[list[str], list[str]]:
    """The wanted columns that df has, and those it lacks."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def complete(df: DataFrame, wanted: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """Rows in which every wanted column that exists is present."""
    own, _ = essentials(df, wanted)
    return df.where(reduce(lambda a, b: a & b, [present(F.col(f"`{c}`")) for c in own], F.lit(True)))


def rejected(df: DataFrame, wanted: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """(column_name, rejected): rows without a value, for each wanted column, in one pass."""
    own, _ = essentials(df, wanted)
    sums = df.agg(*[F.count_if(~present(F.col(f"`{c}`"))).alias(c) for c in own])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("rejected")) for c in own])).alias("x")).select("x.*")


def people(df: DataFrame, order: list, compat_persona_key: bool = False) -> DataFrame:
    """person_id (dense, after the filter) and one column for each feature."""
    name = lambda f: "personas" if f == "persona" and compat_persona_key else f
    kept = dense_id(complete(df), order, "person_id")
    return kept.select("person_id", *[F.col(f"`{c}`").alias(name(f)) for f, c in COLUMNS.items() if c in df.columns])


def profiles(wide: DataFrame, features: list[str], key: str = "person_id") -> DataFrame:
    """(key, feature, profile): the stripped non-empty cells, unpivoted."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), strip(F.col(f)).alias("profile")) for f in features])).alias("x")
    return wide.select(key, cells).select(key, "x.*").where("profile is not null and profile <> ''")


def distinct_profiles(long: DataFrame) -> DataFrame:
    return long.select("feature", "profile").distinct()


def tag_lists(wide: DataFrame, features: list[str], key: str = "person_id") -> DataFrame:
    return wide.select(key, *[tags(F.col(f), SEPARATORS.get(f, "|")).alias(f) for f in features])


def preview(df: DataFrame, order: list, n: int = 10) -> DataFrame:
    """The first n rows, with the table's row and column counts."""
    total = df.agg(F.count("*").alias("total_rows"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("total_columns", F.lit(len(df.columns)))
