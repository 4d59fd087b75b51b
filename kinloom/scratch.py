"""Written intermediate tables and small physical helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str = "kinloom-core") -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "kinloom-shared")
    return f"{found.rstrip('/')}/{name}-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, kind: str = "kinloom-core") -> DataFrame:
    """df as a table in the shared folder, so that it is computed once and lineage ends there."""
    path = f"{folder(df.sparkSession, kind)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dense_id(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with 0, 1, 2 ... in the given order: range partitions are numbered within and shifted by the counts of those before."""
    part = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = sorted((r["_part"], r["n"]) for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect())
    if not counts:
        return part.drop("_part").withColumn(name, F.lit(None).cast("long"))
    shift, total = {}, 0
    for p, n in counts:
        shift[p] = total
        total += n
    before = F.create_map(*[x for p, n in shift.items() for x in (F.lit(p), F.lit(n))])
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn(name, (rank - 1 + before[F.col("_part")]).cast("long")).drop("_part")
