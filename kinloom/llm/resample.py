"""Importance resampling towards a target distribution with hashed n-gram features.

Identical texts are collapsed by grouping the full text; features, counts and
weights are made once for each distinct text, counts times its multiplicity.
Words are runs of digits, letters and non-ASCII characters (A-Z lower-cased);
features are all runs of one to three words joined by a space; a feature's
bucket is the CRC-32 of its bytes modulo `buckets`. CRC-32 is linear, so the
sum of joined strings comes from those of its parts by table look-ups, and a
whole batch of texts is hashed by array steps. Weights are joined back to the
documents by the text's SHA-256 before each document's own noise is added, and
the highest scores are drawn (Gumbel top-k: a sample without replacement).

Defined results: null text has no words; a document without words has weight 0
and still a score; a null id counts as the empty string in its noise; rows
that repeat an id share its noise and rank next to each other; equal scores go
to the smaller id (null first), then to fewer features and the smaller weight;
empty tables give no rows, or gains of an empty target; columns beside the
named ones are not read. A text of any length is handled as a chunk of its
own, at about 60 bytes a byte. Counts are exact up to 2^53.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import flat
from kinloom.llm.common import map_batches, written
from kinloom.operators.components import with_keyed
from kinloom.scratch import dense_id

BUCKETS, LONGEST_RUN, SHARE, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[:128] = False
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

#: CRC-32 register after one byte, and words up to so many bytes that go by array steps; longer ones go to zlib one by one.
_STEP = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)
ARRAY_WORD = 64


def _shift_tables(longest: int) -> np.ndarray:
    """[length, byte, value]: the part of a shifted sum that a byte of the sum adds, for shifts of 0 to `longest` zero bytes."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for b in range(4):
        out[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
    for n in range(1, longest + 1):
        out[n] = _STEP[out[n - 1] & 0xFF] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shift_tables(ARRAY_WORD)


def _shift_long(crc: int, n: int) -> int:
    """The sum shifted by n zero bytes, in steps of the table's longest shift by repeated squaring."""
    power, left = crc, n // ARRAY_WORD
    columns = [_apply(_SHIFT[ARRAY_WORD], 1 << i) for i in range(32)]
    while left:
        if left & 1:
            power = _times(columns, power)
        columns = [_times(columns, c) for c in columns]
        left >>= 1
    return _apply(_SHIFT[n % ARRAY_WORD], power)


def _apply(table: np.ndarray, crc: int) -> int:
    return int(table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24])


def _times(columns: list[int], crc: int) -> int:
    out = 0
    while crc:
        low = crc & -crc
        out ^= columns[low.bit_length() - 1]
        crc ^= low
    return out


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each sum shifted by its own number of zero bytes."""
    short = np.minimum(n, ARRAY_WORD)
    out = _SHIFT[short, 0, crc & 0xFF] ^ _SHIFT[short, 1, crc >> np.uint32(8) & 0xFF] ^ _SHIFT[short, 2, crc >> np.uint32(16) & 0xFF] ^ _SHIFT[short, 3, crc >> np.uint32(24)]
    for i in np.flatnonzero(n > ARRAY_WORD).tolist():
        out[i] = _shift_long(int(crc[i]), int(n[i]))
    return out


def _word_sums(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of lower-cased bytes."""
    order = np.argsort(-np.minimum(size, ARRAY_WORD + 1), kind="stable")
    by_size = size[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    first = starts[order]
    for j in range(int(min(size.max(initial=0), ARRAY_WORD))):
        n = int(np.searchsorted(-by_size, -j, "left"))  # words of more than j bytes
        own = crc[:n]
        crc[:n] = _STEP[(own ^ data[first[:n] + j]) & 0xFF] ^ (own >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > ARRAY_WORD).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + size[i]].tobytes())
    return out


def features(t: flat.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text of each, and each text's number of words."""
    inside = WORD_BYTE[t.data]
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.offs] = True
    before = np.append(False, inside)
    after = np.append(inside, False)
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    size = ends - starts
    sums = _word_sums(flat.LOWER[t.data], starts, size)
    text = np.searchsorted(t.offs, starts, "right") - 1
    found, owner, run = [sums], [text], sums
    for n in range(1, LONGEST_RUN):
        if len(run) < 2:
            break
        # the run before, a space, one word more
        own = run[:-1]
        spaced = _STEP[(own ^ np.uint32(0xFFFFFFFF) ^ np.uint32(32)) & 0xFF] ^ ((own ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
        run = _shifted(spaced, size[n:]) ^ sums[n:]
        whole = text[:-n] == text[n:]
        found.append(run[whole])
        owner.append(text[n:][whole])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(owner), np.bincount(text, minlength=len(t))


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, copies): the distinct texts, null ones as empty."""
    return docs.groupBy(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all (text, copies), one count for each copy; tasks hand on at most `buckets` rows."""

    def run(batches):
        total = np.zeros(buckets)
        for batch in batches:
            copies = batch.column(1).to_numpy()
            for t in flat.texts(batch.column(0)):
                at, owner, _ = features(t, buckets)
                total += np.bincount(at, weights=copies[t.first + owner].astype(float), minlength=buckets)
            pa.default_memory_pool().release_unused()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held].astype(np.int64))], ["bucket", "n"])

    found = texts.select("text", "copies").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"]] = found["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target to source share) of each bucket, smoothed by one."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, copies, n_words, n_features, weight) of each (text, copies)."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)

    def kernel():
        own = shared.value

        def each(batch):
            for t in flat.texts(batch.column(0)):
                at, owner, words = features(t, len(own))
                n = np.bincount(owner, minlength=len(t))
                weight = np.zeros(len(t), np.int64)
                np.add.at(weight, owner, own[at])
                digest = [hashlib.sha256(t.data[s:e].tobytes()).digest() for s, e in zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), batch.column(1).slice(t.first, len(t)), pa.array(words), pa.array(n), pa.array(weight)], ["digest", "copies", "n_words", "n_features", "weight"])

        return each

    return map_batches(texts.select("text", "copies"), kernel, "digest binary, copies long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """floor of -1000 ln(-ln u), with u from the first 32 bits of SHA-256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(spark: SparkSession, docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(<key>, n_words, n_features, weight, score) of every document, against the texts of `target` (a column `text`)."""
    texts = written(spark, distinct_texts(docs, text), "texts")
    gain = gains(bucket_counts(texts, buckets), bucket_counts(distinct_texts(target), buckets))
    weights = written(spark, weighed(texts, gain), "weights")
    rows = written(spark, docs.select(key, F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("digest")), "digests")
    joined = with_keyed(rows, weights, ["digest"], "copies", rows.count())
    return joined.select(key, "n_words", "n_features", "weight", (F.col("weight") + noise(F.col(key))).alias("score"))


def drawn(spark: SparkSession, docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's key, n_features, weight, score and rank; rank is null for those that are not among the share (per cent) drawn of the documents of `least_words` or more."""
    rows = written(spark, scored(spark, docs, target, key, text), "scores")
    enough = rows.where(F.col("n_words") >= least_words)
    most = enough.count() * share // 100
    ranked = dense_id(enough, [F.desc("score"), F.asc(key), F.asc("n_features"), F.asc("weight")], "_place").withColumn("rank", F.when(F.col("_place") < most, F.col("_place") + 1))
    columns = [key, "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").unionByName(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
