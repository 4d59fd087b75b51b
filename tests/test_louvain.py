"""Louvain on tables against the dense kernel, and the dispatch on a graph's size."""

import numpy as np
import pytest

from kinloom.operators import community, louvain, subgraph
from kinloom.plans.analysis import PeopleGraph
from kinloom.schema import Settings


def planted(groups=6, size=12, inside=0.7, outside=0.03, seed=5):
    r = np.random.default_rng(seed)
    n = groups * size
    w = np.where(np.arange(n)[:, None] // size == np.arange(n)[None, :] // size, inside, outside) > r.random((n, n))
    w = np.triu(w * (0.5 + r.random((n, n))), 1)
    return w + w.T


def edges_of(spark, w):
    i, j = np.nonzero(np.triu(w, 1))
    return spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j, strict=True)], "src long, dst long, weight double")


@pytest.mark.parametrize("kernel_nodes", [0, 24])
def test_modularity_is_that_of_the_kernel(spark, kernel_nodes):
    w = planted()
    got = {r.node: r.community for r in louvain.communities(edges_of(spark, w), spark.range(74).withColumnRenamed("id", "node"), kernel_nodes=kernel_nodes).collect()}
    assert got.keys() == set(range(74)) and got[72] == 72 and got[73] == 73  # nodes without edges stay alone
    own = community.renumbered(np.array([got[i] for i in range(72)]))
    best = community.modularity(w, community.louvain(w))
    assert community.modularity(w, own) >= 0.99 * best
    assert all(got[c] == c for c in set(got.values()))


def test_edges_of_graphs_without_structure(spark):
    nodes = spark.range(4).withColumnRenamed("id", "node")
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    assert {r.node: r.community for r in louvain.communities(empty, nodes).collect()} == {i: i for i in range(4)}
    pair = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double")
    got = {r.node: r.community for r in louvain.communities(pair, nodes, kernel_nodes=0).collect()}
    assert got[0] == got[1] and got[2] == 2


def test_large_graphs_take_the_table_forms(spark):
    """Beyond dense_nodes nothing raises: batch peeling finds the subgraph, Louvain its subgroups."""
    w = planted(3, 8)
    e, s = edges_of(spark, w), Settings(dense_nodes=10, min_density=0.05)
    members = PeopleGraph(spark, settings=s).subgraph(e)
    assert members.count() >= 3
    groups = subgraph.subgroups(e, spark.range(24).withColumnRenamed("id", "node"), s).collect()
    assert len({r.community for r in groups}) > 1


def test_paths_on_tables_equal_the_dense_kernel(spark, monkeypatch):
    from kinloom.operators import grid, layout

    monkeypatch.setattr(grid, "TILE", 5)
    line = np.zeros((23, 23))
    line[np.arange(22), np.arange(1, 23)] = 1 + np.arange(22) % 3
    sparse = planted(3, 8, 0.5, 0.05)
    for w in (line + line.T, sparse, np.triu(np.ones((9, 9)), 1)):
        w = np.maximum(w, w.T)
        i, j = np.nonzero(np.triu(w, 1))
        used = np.unique(np.concatenate([i, j]))
        low, high = w[i, j].min(), w[i, j].max()
        d = np.full(w.shape, np.inf)
        d[i, j] = d[j, i] = 2 - 1.9 * (w[i, j] - low) / (high - low) if high > low else 1.0
        np.fill_diagonal(d, 0)
        want = layout.floyd_warshall(d)
        got = {(r.src, r.dst): r.distance for r in layout.paths_on_tables(edges_of(spark, w)).collect()}
        assert got == pytest.approx({(a, b): want[a, b] for a in used for b in used if a < b and np.isfinite(want[a, b])})
