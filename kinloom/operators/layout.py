"""Cycles, shortest paths and the stress layout of one dense matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import grid, paths
from kinloom.operators.graph import on_matrix
from kinloom.operators.pair_graph import Kernel, PairGraph, Tile
from kinloom.scratch import dense_id, dropped, written

#: People up to which one task lays them out from the matrix.
DENSE_LAYOUT = 2000


def held_karp(w: np.ndarray) -> tuple[list[int], float]:
    """The heaviest Hamiltonian cycle from node 0, by dynamic programming over subsets."""
    n = len(w)
    if n < 3:
        return [], 0.0
    best = np.full((1 << n, n), -np.inf)
    back = np.full((1 << n, n), -1)
    best[1, 0] = 0
    for s in range(1, 1 << n, 2):
        for x in np.flatnonzero(np.isfinite(best[s])):
            for y in range(1, n):
                if not s >> y & 1 and w[x, y] > 0 and best[s, x] + w[x, y] > best[s | 1 << y, y]:
                    best[s | 1 << y, y], back[s | 1 << y, y] = best[s, x] + w[x, y], x
    full = (1 << n) - 1
    ends = np.where(w[:, 0] > 0, best[full] + w[:, 0], -np.inf)
    ends[0] = -np.inf
    x = int(ends.argmax())
    if not np.isfinite(ends[x]):
        return [], 0.0
    path, s, total = [], full, float(ends[x])
    while x >= 0:
        path.append(int(x))
        s, x = s & ~(1 << x), int(back[s, x])
    path = path[::-1]
    return (path if path[1] < path[-1] else [path[0], *path[:0:-1]]), total  # of the two directions the one that goes to the lower neighbour


def greedy_cycle(w: np.ndarray) -> tuple[list[int], float]:
    """From node 0 always to the heaviest unvisited neighbour (the lower of equal ones), closed if that edge exists."""
    if len(w) < 3:
        return [], 0.0
    path, left, total = [0], set(range(1, len(w))), 0.0
    while left:
        own = sorted(left)
        x = own[int(w[path[-1], own].argmax())]
        total += w[path[-1], x]
        path.append(x)
        left.remove(x)
    return path, float(total + w[path[-1], 0])


def cycle(edges: DataFrame, exact: int = 10) -> DataFrame:
    """(position, node, weight): a maximum cycle, exact up to `exact` nodes, greedy beyond; weight is the whole cycle's."""

    def kernel(ids, w):
        path, total = held_karp(w) if len(ids) <= exact else greedy_cycle(w)
        return pd.DataFrame({"position": np.arange(len(path)), "node": ids[path] if path else np.zeros(0, np.int64), "weight": total})

    return on_matrix(edges, kernel, "position long, node long, weight double")


def cycle_of_pairs(own: PairGraph, exact: int = 10) -> DataFrame:
    """As cycle, of the complete graph of people; beyond `exact` people the greedy walk makes the weights of one person at a time.

    The walk is a chain in which each step needs all before, so one task takes
    it; that task holds the people (their vectors), not the matrix.
    """
    if own.n <= exact:
        return cycle(own.edges(), exact)
    return own.in_one_task(_walk, "position long, node long, weight double")


def _walk(kernel: Kernel, tiles: list[Tile]) -> pd.DataFrame:
    ids, vectors = np.concatenate([t.ids for t in tiles]), [np.concatenate(v) for v in zip(*(t.vectors for t in tiles), strict=True)]
    combos, of = np.unique(np.concatenate([t.combos[t.of] for t in tiles]), axis=0, return_inverse=True)
    of = of.reshape(-1)
    one = lambda x: Tile(ids[[x]], [v[[x]] for v in vectors], combos[[of[x]]], np.zeros(1, np.int64), np.ones(1, np.int64))
    left, at, path, total = None, np.arange(len(ids)), [0], 0.0
    gone = np.zeros(len(ids), bool)
    gone[0] = True
    while len(path) < len(ids):
        if left is None or 8 * gone[at].sum() > len(at) and len(path) % 64 == 0:
            at = at[~gone[at]]
            left = Tile(ids[at], [np.ascontiguousarray(v[at]) for v in vectors], combos, of[at], np.bincount(of[at], minlength=len(combos)))
        w = kernel.weights(one(path[-1]), left)[0]
        w[gone[at]] = -np.inf
        x = int(w.argmax())
        total += float(w[x])
        path.append(int(at[x]))
        gone[at[x]] = True
    a, b = min(path[0], path[-1]), max(path[0], path[-1])
    total += float(kernel.weights(one(a), one(b))[0, 0])
    return pd.DataFrame({"position": np.arange(len(path)), "node": ids[path], "weight": total})


def distances(w: np.ndarray) -> np.ndarray:
    """2 - 1.9 * weight scaled to [0, 1]; 1 where all weights are equal."""
    upper = w[np.triu_indices(len(w), 1)]
    low, high = upper.min(), upper.max()
    d = 2 - 1.9 * (w - low) / (high - low) if high > low else np.ones_like(w)
    np.fill_diagonal(d, 0)
    return d


def floyd_warshall(d: np.ndarray) -> np.ndarray:
    d = d.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k], out=d)
    return d


def shortest_paths(edges: DataFrame) -> DataFrame:
    def kernel(ids, w):
        d = floyd_warshall(distances(w))
        i, j = np.triu_indices(len(ids), 1)
        return pd.DataFrame({"src": ids[i], "dst": ids[j], "distance": d[i, j]})

    return on_matrix(edges, kernel, "src long, dst long, distance double")


def paths_on_tables(edges: DataFrame) -> DataFrame:
    """(src, dst, distance) of all connected pairs, as shortest_paths, on a grid of tasks.

    The distance matrix is a table of rows. A round is its min-plus square:
    two rows meet once on the triangular grid (operators/grid.py) and give the
    shortest way over any third node, so paths of twice the edges are known
    after each round and log2 of the longest is enough. A task holds one strip
    of rows; a row holds a number for each node.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = written(dense_id(ends, ["node"], "at"), "nodes")
    n, low, high = nodes.count(), *edges.agg(F.min("weight"), F.max("weight")).first()
    if not n:
        return edges.select("src", "dst", F.col("weight").alias("distance"))
    away = 2 - 1.9 * (F.col("weight") - low) / F.lit(high - low) if high > low else F.lit(1.0)
    a, b = (nodes.select(F.col("node").alias(x), F.col("at").alias(y)) for x, y in (("src", "i"), ("dst", "j")))
    pairs = edges.join(a, "src").join(b, "dst").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), away.alias("distance"))

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full(n, np.inf)
        out[rows["j"]] = rows["distance"]
        out[rows["i"].iloc[0]] = 0.0
        return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [out]})

    def prepare(rows: pa.RecordBatch):
        return rows.column("i").to_numpy(), rows.column("row").flatten().to_numpy().reshape(-1, n)

    def square(left, right, keep):
        i, j = np.nonzero(keep)
        old = left[1][:, right[0]][i, j]
        new = np.stack([(x + right[1]).min(axis=1) for x in left[1]])[i, j]
        near = np.isfinite(new)
        return pa.RecordBatch.from_arrays([pa.array(left[0][i][near]), pa.array(right[0][j][near]), pa.array(new[near]), pa.array(new[near] < old[near])], ["i", "j", "distance", "better"])

    sides = grid.strips(n, 8 * n, grid.tasks_of(edges))
    known = written(pairs.groupBy("i", "j").agg(F.min("distance").alias("distance")), "paths")
    while True:
        both = known.select("i", "j", "distance").unionByName(known.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
        rows = both.groupBy("i").applyInPandas(filled, "i long, row array<double>")
        strip = F.floor(F.col("i") * sides / F.lit(n))
        new = written(grid.triangle(rows, strip, sides, ["i"], prepare, square, "i long, j long, distance double, better boolean"), "paths")
        better = not new.where("better").isEmpty()
        dropped(known)
        known = new
        if not better:
            break
    src, dst = (nodes.select(F.col("at").alias(y), F.col("node").alias(x)) for x, y in (("src", "i"), ("dst", "j")))
    return known.join(src, "i").join(dst, "j").select("src", "dst", "distance")


def smacof(d: np.ndarray, seed: int = 42, rounds: int = 300, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Metric scaling to two dimensions by majorisation: coordinates and raw stress."""
    n = len(d)
    x, old = np.random.default_rng(seed).random((n, 2)), np.inf
    for _ in range(rounds):
        own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        stress = ((own - d) ** 2).sum() / 2
        if old - stress < tolerance * max(old, 1e-12) and np.isfinite(old):
            break
        old = stress
        b = -np.divide(d, own, out=np.zeros_like(d), where=own > 0)
        b[np.arange(n), np.arange(n)] -= b.sum(axis=1)
        x = b @ x / n
    return x, float(stress)


def stress_layout(edges: DataFrame) -> DataFrame:
    """(node, x, y, stress): coordinates scaled to [0, 1] on each axis; on a circle, without a stress, where scaling gives no numbers."""

    return on_matrix(edges, _placed, "node long, x double, y double, stress double")


def _placed(ids: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    return scaled_places(ids, *smacof(floyd_warshall(distances(w))))


def scaled_places(ids: np.ndarray, x: np.ndarray, stress: float) -> pd.DataFrame:
    if not np.isfinite(x).all():
        at = np.array(circle(len(ids))).reshape(-1, 2)
        return pd.DataFrame({"node": ids, "x": at[:, 0], "y": at[:, 1], "stress": np.nan})
    low, span = x.min(axis=0), np.ptp(x, axis=0)
    x = (x - low) / np.where(span > 0, span, 1)
    return pd.DataFrame({"node": ids, "x": x[:, 0], "y": x[:, 1], "stress": stress})


def stress_layout_of_pairs(own: PairGraph, dense: int = DENSE_LAYOUT, rounds: int = 300, tolerance: float = 1e-6) -> DataFrame:
    """As stress_layout, of a complete graph; beyond `dense` people on tables.

    Their shortest paths are written once as rows of distances, and a round of
    the majorisation is one pass over these: a row needs all coordinates (two
    numbers a person, broadcast) and gives its own new ones and its stress.
    """
    if own.n <= dense:
        return own.on_matrix(_placed, "node long, x double, y double, stress double")
    spark, n = own.rows.sparkSession, own.n
    ids = np.sort(own.rows.select("id").toArrow().column("id").to_numpy())
    shared = spark.sparkContext.broadcast(ids)
    found = paths.paths_of_pairs(own)
    both = found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(n)
        out[np.searchsorted(shared.value, rows["dst"])] = rows["distance"]
        return pd.DataFrame({"node": rows["src"].iloc[:1], "away": [out]})

    table = written(both.groupBy("src").applyInPandas(filled, "node long, away array<double>"), "away")

    def moved(x: np.ndarray):
        now = spark.sparkContext.broadcast(x)

        def run(batches):
            for whole in batches:
                for at in range(0, len(whole), 64):
                    rows = whole.slice(at, 64)
                    d = rows.column("away").flatten().to_numpy().reshape(-1, n)
                    all_x, mine = now.value, np.searchsorted(shared.value, rows.column("node").to_numpy())
                    gone = np.sqrt((all_x[mine, 0, None] - all_x[None, :, 0]) ** 2 + (all_x[mine, 1, None] - all_x[None, :, 1]) ** 2)
                    b = np.divide(d, gone, out=np.zeros_like(d), where=gone > 0)
                    new = (all_x[mine] * b.sum(axis=1)[:, None] - b @ all_x) / n
                    yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(new[:, 0]), pa.array(new[:, 1]), pa.array(((gone - d) ** 2).sum(axis=1) / 2)], ["node", "x", "y", "stress"])

        got = table.mapInArrow(run, "node long, x double, y double, stress double").toArrow().sort_by("node")
        now.unpersist()
        return np.stack([got.column("x").to_numpy(), got.column("y").to_numpy()], axis=1), float(got.column("stress").to_numpy().sum())

    x, old, stress = np.random.default_rng(42).random((n, 2)), np.inf, np.inf
    for _ in range(rounds):
        new, stress = moved(x)
        if old - stress < tolerance * max(old, 1e-12) and np.isfinite(old):
            break
        x, old = new, stress
    dropped(table)
    return spark.createDataFrame(pa.Table.from_pandas(scaled_places(ids, x, stress), preserve_index=False), "node long, x double, y double, stress double")


def circle(n: int) -> list[tuple[float, float]]:
    """Fallback layout on a circle."""
    at = 2 * np.pi * np.arange(n) / max(n, 1)
    return [(float(x), float(y)) for x, y in zip(0.5 + 0.3 * np.cos(at), 0.5 + 0.3 * np.sin(at), strict=True)]
