"""A training corpus from `documents`: five stages, each written as Parquet and read again.

Language identification drops what it can't identify, near-duplicate detection
keeps one document of each class, decontamination drops documents that hold a
benchmark item, the secret scan masks what it finds, and the last stage
encodes the texts.

Defined results, of all stages: a null or empty text has no letter and goes
with the first stage; nulls in other columns stay as they are; rows that repeat
an id are documents of their own, compared by their texts, and repeated rows
are near-duplicates of which one stays; of texts that tie, the smallest id
stays; texts of any length are read whole; an empty table gives an empty one;
further columns are carried along, and where one has a name that the last stage
makes, the stage's own column gets an underscore. A stage's table is deleted
once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontaminate, language_id, neardup, pieces, secrets
from kinloom.llm.common import bucket_of, shared_dir, table
from kinloom.scratch import delete


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (operator 10); learnt from their own labels, as the operator's query does."""
    learn = docs.where(bucket_of("doc_id", 5) != 0).select(F.col("doc_id").alias("key"), "text", "lang")
    return language_id.keep_identified(docs, language_id.fit(spark, learn))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id (operator 3)."""
    return neardup.deduplicated(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 1)."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew (operator 4)."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' other columns with ids, n_pieces, n_bytes and exact (operator 9)."""
    return pieces.encoded(docs, pieces.load(), [c for c in docs.columns if c != "text"])


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mask_secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the naive Bayes stage nor decoding worklists nor Viterbi; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
