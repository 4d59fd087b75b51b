"""What the operators share: tables, written intermediate tables and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom import scratch

#: Rows that a kernel holds a second copy of at once.
SLICE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    return scratch.folder(spark, "kinloom")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs only tasks."""
    return scratch.written(df, name, "kinloom")


def clear(spark: SparkSession) -> None:
    """Deletes all that written() left; results that read it must have been saved before."""
    scratch.delete(spark, shared_dir(spark))


def own_names(outputs: list[str], taken: list[str]) -> list[str]:
    """Names for an operator's own columns beside the `taken` ones: an underscore is put behind a name until it is free (case aside)."""
    used, out = {x.lower() for x in taken}, []
    for name in outputs:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def with_text(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    """Columns `keep` of df and its text column behind them (cast to string), and the schema of `keep`."""
    kept = df.select(*keep)
    name = own_names(["_text"], keep)[0]
    return df.select(*keep, F.col(text).cast("string").alias(name)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)


def bucket_of(doc_id: str, mod: int) -> "F.Column":
    """crc32 of the id as text, mod `mod`; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def map_batches(df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow where kernel() is called once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = kernel()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, kernel: Callable[[], Callable[[pa.Array], "object"]]) -> DataFrame:
    """Rows of df, all columns as they are, for which the kernel's mask over `column` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = kernel()
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                yield part.filter(pa.array(keep(part.column(part.schema.get_field_index(column))), pa.bool_()))
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
