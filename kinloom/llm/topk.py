"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows: the weight of term (dimension) t is
floor(1024 * x[t]). Candidates stream in tiles; for each term the queries that
hold it scatter query weight times posting weight into a dense score array
(queries x tile). Partition selection keeps the k best of a tile, tiles are
merged within a task and tasks by a ranked window.

Queries and candidates are dealt over a grid of tasks: a task holds one strip
of queries (QUERY_BYTES) and lets one strip of candidates stream past it, so
nothing passes the driver and all strips go at once. Vectors are tiled by
length, so a long one doesn't widen the others' tiles, and a tile holds at
most TILE_BYTES. Scores are added in float64, in 64-bit or in whole Python
numbers, whichever holds terms x largest weight x largest weight exactly.

Defined results: null vectors, vectors with null or non-finite components and
rows without an id take no part; a shorter vector's missing terms weigh 0; a
candidate is never returned for its own id; an id that repeats asks once (its
smallest vector), and as a candidate counts for each row; equal scores go to
the smaller id; scores beyond a long are cut to its range; other columns are
not read, so they may have any name. Of a vector of any length one row at a
time is held beside its tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.operators import grid

SCALE = 1024
QUERY_BYTES = 32 << 20
TILE_BYTES = 32 << 20
TILE_ROWS, TILE_QUERIES = 2048, 128
_LONG = (1 << 63) - 1


def weights(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), whole numbers in float64."""
    return np.floor(values.astype(np.float64) * SCALE)


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows that take part, and their components as a matrix (padded with 0): tiles of rows of like length."""
    lists = column.cast(pa.list_(pa.float64()))
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat_values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    at = np.concatenate(([0], np.cumsum(size)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat_values))))
    good = np.flatnonzero(np.asarray(lists.is_valid()) & (np.diff(bad[at]) == 0))
    grade = np.ceil(np.log2(np.maximum(size[good], 1))).astype(np.int64)
    for g in np.unique(grade).tolist():
        alike = good[grade == g]
        step = max(1, min(TILE_ROWS, TILE_BYTES // (8 << g)))
        for s in range(0, len(alike), step):
            rows = alike[s : s + step]
            n = size[rows]
            out = np.zeros((len(rows), int(n.max())))
            row = np.repeat(np.arange(len(rows)), n)
            before = np.cumsum(n) - n
            out[row, np.arange(len(row)) - np.repeat(before, n)] = flat_values[np.repeat(at[:-1][rows] - before, n) + np.arange(len(row))]
            yield rows, out


class Postings:
    """Weights by term: for each term the rows that hold it and their weights; None for rows where all hold it."""

    def __init__(self, matrix: np.ndarray):
        self.n, self.top, self.terms = len(matrix), int(np.abs(matrix).max(initial=0)), []
        for column in np.ascontiguousarray(matrix.T):
            rows = np.flatnonzero(column)
            self.terms.append((None, column) if len(rows) == self.n else (rows, column[rows]))


def _whole(values: np.ndarray, kind: type) -> np.ndarray:
    """The weights in float64, int64 or as Python numbers."""
    if kind is object:
        return np.array([int(v) for v in values] + [None], object)[:-1]
    return values.astype(kind, copy=False)


def accumulate(queries: Postings, tile: Postings) -> np.ndarray:
    """Scores (queries x rows of the tile), term by term: each posting adds to the scores of the queries that hold its term."""
    most = min(len(queries.terms), len(tile.terms)) * queries.top * tile.top
    kind = np.float64 if most < 1 << 53 else np.int64 if most <= _LONG else object
    scores = np.zeros((queries.n, tile.n), kind)
    for (has, ask), (holds, post) in zip(queries.terms, tile.terms, strict=False):
        if len(ask) and len(post):
            added = np.multiply.outer(_whole(ask, kind), _whole(post, kind))
            if has is None and holds is None:
                scores += added
            else:
                scores[np.ix_(np.arange(queries.n) if has is None else has, np.arange(tile.n) if holds is None else holds)] += added
    return scores


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[list[tuple]] = [[] for _ in ids]

    def add(self, first: int, scores: np.ndarray, vec_ids: np.ndarray) -> None:
        k = self.k
        for j in range(len(scores)):
            own, row = self.found[first + j], scores[j]
            take = np.flatnonzero(vec_ids != self.ids[first + j])
            if len(own) == k:
                take = take[row[take] >= -own[-1][0]]
            if len(take) > k:
                least = np.partition(row[take], len(take) - k)[len(take) - k]
                take = take[row[take] >= least]
            if len(take):
                self.found[first + j] = sorted(own + [(-s, i) for s, i in zip(row[take].tolist(), vec_ids[take].tolist(), strict=True)])[:k]


class _Search(grid.Cell):
    """One strip of queries against one strip of candidates: hands on the k best of each query."""

    def __init__(self, number: int, k: int):
        super().__init__(number)
        self.k, self.tiles = k, []

    def left(self, rows):
        ids = rows.column("id").to_numpy()
        for good, matrix in rows_of(rows.column("vector")):
            for s in range(0, len(good), TILE_QUERIES):
                own = ids[good[s : s + TILE_QUERIES]]
                self.tiles.append((Postings(weights(matrix[s : s + TILE_QUERIES])), Best(own, self.k)))

    def right(self, rows):
        ids = rows.column("id").to_numpy()
        for good, matrix in rows_of(rows.column("vector")):
            tile = Postings(weights(matrix))
            for asked, best in self.tiles:
                best.add(0, accumulate(asked, tile), ids[good])
        return iter(())

    def end(self):
        found = [(q, i, min(max(int(-s), -_LONG - 1), _LONG)) for _, best in self.tiles for q, own in zip(best.ids.tolist(), best.found, strict=True) for s, i in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def nearest(spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; both have id and vector."""
    take = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    ask, rows = take(queries).groupBy("id").agg(F.min("vector").alias("vector")), take(candidates)
    n, held = ask.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()
    tasks = grid.tasks_of(rows)
    a = max(1, math.ceil(held / QUERY_BYTES), min(math.ceil(n / TILE_QUERIES), math.isqrt(tasks)))
    b = max(1, math.ceil(tasks / a))
    strip = lambda of: F.pmod(F.xxhash64("id"), F.lit(of))
    # ids that repeat meet in one strip; deal them by their vectors too
    deal = F.pmod(F.xxhash64("id", "vector"), F.lit(b))
    found = grid.rectangle(ask, rows, strip(a), deal, (a, b), ["id"], lambda c: _Search(c, k), "query_id long, vec_id long, score long", TILE_ROWS)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
