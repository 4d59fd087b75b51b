"""Graphs as tables: nodes (id) and edges (src < dst, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import linked
from kinloom.operators.selection import quantile
from kinloom.scratch import dropped, written


def incident(edges: DataFrame) -> DataFrame:
    """(node, other, weight), each edge from both ends."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")
    return edges.select(ends, "weight").select("e.*", "weight")


def induced(edges: DataFrame, members: DataFrame, node: str = "node") -> DataFrame:
    """Edges between members."""
    own = members.select(F.col(node).alias("src"))
    return edges.join(own, "src", "left_semi").join(own.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_nodes, n_edges, density (sum of weights by n(n-1)/2, 0 for n < 2) and the mean weight of edges."""
    return density_of_blocks(edges.agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), nodes)


def density_of_blocks(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """As density, from counts n and sums of weights."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    e = e.withColumn("mean_weight", F.coalesce(F.try_divide("total", "n_edges"), F.lit(0.0)))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return n.crossJoin(F.broadcast(e)).select("n_nodes", "n_edges", F.when(F.col("n_nodes") > 1, F.col("total") / possible).otherwise(0.0).alias("density"), "mean_weight")


def weighted_degree(edges: DataFrame) -> DataFrame:
    return incident(edges).groupBy("node").agg(F.sum("weight").alias("degree"))


def above_percentile(edges: DataFrame, q: float) -> DataFrame:
    """Edges of at least the q-th percentile of the weights (linear interpolation), which is selected by histograms; edges is a written table."""
    cut = quantile(edges, "weight", q / 100)
    return edges.where(F.col("weight") >= cut) if cut is not None else edges.limit(0)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; a node without edges is its own."""
    found = linked(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def blocks(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b, n, weight): the edges and their weights by the communities that they join."""
    a = membership.select(F.col("node").alias("src"), F.col("community").alias("a"))
    b = membership.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def community_metrics(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """community, size, internal_weight, external_weight, density, cohesion_ratio; communities of two or more."""
    return metrics_of_blocks(blocks(edges, membership), membership)


def metrics_of_blocks(own: DataFrame, membership: DataFrame) -> DataFrame:
    return metrics_of_sums(sums_of_blocks(own), membership)


def sums_of_blocks(own: DataFrame) -> DataFrame:
    """(community, internal_weight, external_weight) of blocks."""
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("community"), F.lit(1).alias("inside")))).otherwise(F.array(F.struct(F.col("a").alias("community"), F.lit(0).alias("inside")), F.struct(F.col("b").alias("community"), F.lit(0).alias("inside"))))).alias("x")
    return own.select(sides, "weight").groupBy("x.community").agg(F.sum(F.when(F.col("x.inside") == 1, F.col("weight")).otherwise(0.0)).alias("internal_weight"), F.sum(F.when(F.col("x.inside") == 0, F.col("weight")).otherwise(0.0)).alias("external_weight"))


def modularity_of_sums(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As modularity, of (community, internal_weight, external_weight) of all communities; with columns `by`, for each of their graphs."""
    m = sums.groupBy(*by or []).agg(F.sum(F.col("internal_weight") + F.col("external_weight") / 2).alias("m"))
    degree = 2 * F.col("internal_weight") + F.col("external_weight")
    every = sums.join(F.broadcast(m), by) if by else sums.crossJoin(F.broadcast(m))
    return every.groupBy(*by or []).agg(F.coalesce(F.sum(F.col("internal_weight") / F.col("m") - F.pow(degree / (2 * F.col("m")), F.lit(2.0))), F.lit(0.0)).alias("modularity"))


def metrics_of_sums(sums: DataFrame, membership: DataFrame) -> DataFrame:
    return with_metrics(membership.groupBy("community").agg(F.count("*").alias("size")).where("size > 1").join(sums, "community", "left").fillna(0.0, ["internal_weight", "external_weight"]))


def with_metrics(out: DataFrame) -> DataFrame:
    """density and cohesion_ratio beside size, internal_weight and external_weight."""
    total = F.col("internal_weight") + F.col("external_weight")
    return out.withColumns({"density": F.try_divide(F.col("internal_weight"), F.col("size") * (F.col("size") - 1) / 2), "cohesion_ratio": F.when(total > 0, F.col("internal_weight") / total).otherwise(0.0)})


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Weighted modularity: sum over communities of inside / m - (degrees / 2m)^2."""
    return modularity_of_blocks(blocks(edges, membership), edges.agg(F.sum("weight").alias("m")))


def modularity_of_blocks(own: DataFrame, m: DataFrame) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.col("a").alias("c")), F.struct(F.col("b").alias("c")))).alias("x")
    sums = own.select(sides, "weight", (F.col("a") == F.col("b")).alias("inside")).groupBy("x.c").agg(F.sum("weight").alias("d"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("l"))
    return sums.crossJoin(F.broadcast(m)).agg(F.coalesce(F.sum(F.col("l") / 2 / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))), F.lit(0.0)).alias("modularity"))


def quality(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Separation of inner and outer mean weights, less for uneven sizes, more for several communities; -1 without both kinds of pairs."""
    return quality_of_blocks(blocks(edges, membership), membership)


def quality_of_blocks(own: DataFrame, membership: DataFrame) -> DataFrame:
    mean = lambda same: F.try_divide(F.sum(F.when(same, F.col("weight"))), F.sum(F.when(same, F.col("n"))))
    means = own.agg(mean(F.col("a") == F.col("b")).alias("inner"), mean(F.col("a") != F.col("b")).alias("outer"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.var_pop("n").alias("spread"), F.avg("n").alias("mean"))
    penalty = F.least(F.lit(1.0), F.col("spread") / (F.col("mean") * F.col("mean")))
    score = (F.col("inner") - F.col("outer")) / F.greatest(F.col("inner") + F.col("outer"), F.lit(0.001)) * (1 - 0.3 * penalty) * (1 + 0.2 * F.least(F.lit(1.0), F.col("k") / 5))
    return means.crossJoin(F.broadcast(sizes)).select("k", F.coalesce(score, F.lit(-1.0)).alias("quality"))


# --- one dense matrix -----------------------------------------------------------------------------


def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Node ids in order and the symmetric weight matrix."""
    ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]])) if len(pdf) else np.zeros(0, np.int64)
    w = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
    w[i, j] = w[j, i] = pdf["weight"]
    return ids, w


def on_matrix(edges: DataFrame, kernel, schema: str, most: int = 10_000) -> DataFrame:
    """kernel(ids, matrix) -> pandas frame in one task; refuses graphs of more than `most` nodes, whose matrix would not fit."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("n")).agg(F.approx_count_distinct("n")).first()[0]
    if n > most * 1.1:
        raise ValueError(f"about {n} nodes; the dense kernel takes {most}: use the batch form")
    return edges.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda pdf: kernel(*dense(pdf)), schema)


def peel_order(w: np.ndarray) -> list[tuple[int, float, float]]:
    """(node, degree when removed, density before its removal): always the least weighted degree, the lower index of equal ones."""
    alive, degree, out = np.ones(len(w), bool), w.sum(axis=1), []
    for n in range(len(w), 0, -1):
        total = degree[alive].sum() / 2
        x = int(np.where(alive, np.round(degree, 9), np.inf).argmin())  # equal up to rounding: the lower index
        out.append((x, float(degree[x]), total / (n * (n - 1) / 2) if n > 1 else 0.0))
        alive[x] = False
        degree = np.where(alive, degree - w[x], 0.0)
        if n % 64 == 0:
            degree = np.where(alive, w[:, alive].sum(axis=1), 0.0)  # against drift
    return out


def peeling(edges: DataFrame) -> DataFrame:
    """(step, node, degree, density): greedy peeling of the whole graph."""

    def kernel(ids, w):
        rows = peel_order(w)
        return pd.DataFrame({"step": np.arange(len(rows)), "node": ids[[r[0] for r in rows]], "degree": [r[1] for r in rows], "density": [r[2] for r in rows]})

    return on_matrix(edges, kernel, "step long, node long, degree double, density double")


def dense_subgraph(edges: DataFrame, min_density: float) -> DataFrame:
    """(node, density) of the largest prefix of three or more nodes that reaches min_density while peeling; empty if none does."""

    def kernel(ids, w):
        rows = peel_order(w)
        for s, (_, _, d) in enumerate(rows):
            if len(rows) - s < 3:
                break
            if d >= min_density:
                return pd.DataFrame({"node": np.sort(ids[[r[0] for r in rows[s:]]]), "density": d})
        return pd.DataFrame({"node": np.zeros(0, np.int64), "density": np.zeros(0)})

    return on_matrix(edges, kernel, "node long, density double")


def batch_peeling(edges: DataFrame, min_density: float, epsilon: float = 0.1) -> DataFrame:
    """(node) of a dense subgraph of a graph of any size: rounds that remove all nodes of a degree up to (1 + epsilon) times the mean (Bahmani et al., 2012)."""
    e = written(edges, "peel")
    while True:
        nodes = written(weighted_degree(e), "degrees")
        n, total = nodes.agg(F.count("*"), F.sum("degree")).first()
        if not n or n < 3 or total / 2 / (n * (n - 1) / 2) >= min_density:
            dropped(e)
            return nodes.select("node") if n and n >= 3 else nodes.select("node").limit(0)
        left = nodes.where(F.col("degree") > (1 + epsilon) * total / n)
        old, e = e, written(induced(e, left), "peel")
        dropped(old, nodes)
