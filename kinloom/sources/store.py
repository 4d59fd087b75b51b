"""Keyed tables: key-value entries with expiry, sets, content-addressed caches, versions, graphs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.text import content_key
from kinloom.scratch import delete, dropped, written


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both tables' rows, the last of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


#: Folders of a stored table by the hash of its keys.
BUCKETS = 64


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def save_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A table in folders by the hash of its keys; a bucket's rows are written by one task of its own."""
    own = _bucketed(rows, keys, buckets)
    own.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def get_keyed(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The stored rows of the wanted keys; only their buckets are read."""
    found = [r["bucket"] for r in _bucketed(wanted, keys, buckets).select("bucket").distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(found)).drop("bucket").join(wanted.select(*keys).distinct(), keys, "left_semi")


def upsert_keyed(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], buckets: int = BUCKETS) -> None:
    """Puts rows into a stored table, the last of each key by `order`; buckets without a new key keep their files.

    The touched buckets (their numbers, at most `buckets`, come to the driver)
    are merged into a table of their own first and then replaced as whole
    partitions, so a lost executor costs tasks only.
    """
    new = written(_bucketed(new, keys, buckets), "upserts")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    _replace(written(upserted(old, new, keys, order), "merged"), path, buckets)
    dropped(new)


def _replace(rows: DataFrame, path: str, buckets: int) -> None:
    rows.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    dropped(rows)


def expire_keyed(spark: SparkSession, path: str, now: Column, expires: str = "expires_at", buckets: int = BUCKETS) -> None:
    """Compaction: buckets that hold expired rows are written again without them; a bucket that has no other rows goes."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy("bucket").agg(F.count_if(F.col(expires) <= now).alias("old"), F.count("*").alias("n")).where("old > 0").collect()
    mixed, empty = [r["bucket"] for r in counts if r["old"] < r["n"]], [r["bucket"] for r in counts if r["old"] == r["n"]]
    if mixed:
        _replace(written(live(rows.where(F.col("bucket").isin(mixed)), now, expires), "live"), path, buckets)
    for b in empty:
        delete(spark, f"{path}/bucket={b}")


def live(entries: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return entries.where(F.col(expires).isNull() | (F.col(expires) > now))


def without_keys(entries: DataFrame, like: str, key: str = "key") -> DataFrame:
    """All but the keys of a pattern (* for any run of characters)."""
    return entries.where(~F.coalesce(F.col(key).like(like.replace("%", r"\%").replace("*", "%")), F.lit(False)))


def with_keys(entries: DataFrame, like: str, key: str = "key") -> DataFrame:
    return entries.where(F.col(key).like(like.replace("%", r"\%").replace("*", "%")))


def set_add(members: DataFrame, more: DataFrame) -> DataFrame:
    return members.unionByName(more).distinct()


def set_remove(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["key", "member"], "left_anti")


def prefix_stats(entries: DataFrame, key: str = "key") -> DataFrame:
    """(prefix, entries) by the part before the first colon."""
    return entries.groupBy(F.substring_index(key, ":", 1).alias("prefix")).agg(F.count("*").alias("entries"))


def hits(wanted: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Wanted rows whose text is cached, with what is cached; the cache is keyed by md5 of the text."""
    return wanted.withColumn("key", content_key(F.col(text))).join(cache, "key")


def misses(wanted: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    return wanted.withColumn("key", content_key(F.col(text))).join(cache.select("key"), "key", "left_anti")


def write_back(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries; a key keeps its first value."""
    return cache.unionByName(new.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]))


def save_version(df: DataFrame, root: str, version_id: str) -> str:
    path = f"{root}/version_id={version_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_version(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/version_id={version_id}")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def links_json(edges: DataFrame) -> DataFrame:
    """One node-link JSON object for each edge."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("link"))


def links_from_json(lines: DataFrame) -> DataFrame:
    x = F.from_json("link", "source long, target long, weight double")
    return lines.select(x["source"].alias("src"), x["target"].alias("dst"), x["weight"].alias("weight"))


def load_version_or_path(spark: SparkSession, root: str, version_id: str, path: str | None, schema: str) -> DataFrame:
    """A stored version; where it can't be read, the file at `path`, else an empty table of the schema."""
    for read in (lambda: load_version(spark, root, version_id), lambda: spark.read.parquet(path) if path else None):
        try:
            if (found := read()) is not None:
                return found
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)
