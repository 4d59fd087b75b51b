"""Connected components without a task that holds a hub's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.scratch import dropped, written

#: A node (or key) with more rows than this, and than one MAX_HUBS-th of all, is a hub: its rows are dealt over several tasks.
HUB_ROWS = 1024
#: So there are at most this many hubs, whatever the input (a few dozen bytes each when broadcast).
MAX_HUBS = 100_000


def hub_limit(rows: int) -> int:
    return max(HUB_ROWS, rows // MAX_HUBS)


def with_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows, `total` in all, with `keyed`, one row for each key that holds its number of rows as column `n`.

    Keys of many rows are few, so their side is broadcast and their rows stay
    where they are; only the rest is shuffled.
    """
    limit = hub_limit(total)
    hubs = keyed.where(F.col(n) > limit)
    if hubs.isEmpty():
        return rows.join(keyed, keys)
    rest = rows.join(F.broadcast(hubs.select(*keys)), keys, "left_anti").join(keyed.where(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hubs), keys).unionByName(rest)


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Rows (u, v), `total` at most, joined with least (w, m; one row for each w) on u = w.

    A hub's rows are dealt by v and its one row of least is copied to each deal.
    """
    limit = hub_limit(total)
    hubs = rows.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("u").alias("hub"), F.ceil(F.col("n") / limit).cast("long").alias("deals"))
    hubs = written(hubs, "hubs")
    if hubs.isEmpty():
        return rows.join(least, F.col("u") == F.col("w"))
    dealt = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("deals")), F.lit(0)).alias("deal"))
    copies = least.join(F.broadcast(hubs), F.col("w") == F.col("hub"), "left").select("w", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("deals", F.lit(1)) - 1)).alias("copy"))
    return dealt.join(copies, (F.col("u") == F.col("w")) & (F.col("deal") == F.col("copy"))).select("u", "v", "w", "m")


def linked(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges (a, b); nodes without an edge to another are not listed.

    Alternating large-star and small-star steps (Kiveris et al., 2014) as
    aggregates and joins; hub nodes are pre-aggregated and their joins are
    split, no neighbour list is ever gathered. A round's table is deleted once
    the next one is written.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = written(e, "edges")
    state, n = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), low, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = _with_least(large, least, n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        old, e = e, written(small, "edges")
        dropped(old, large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, n = now, now[0]
    label = e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    out = written(label.unionByName(label.select(F.col("label").alias("node"), "label").distinct()), "labels")
    dropped(e)
    return out
