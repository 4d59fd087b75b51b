"""Components and joins whose hub keys are dealt."""

import random

from pyspark.sql import functions as F

from kinloom.operators import components, graph


def brute(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_with_hubs_dealt(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 8)
    r = random.Random(3)
    pairs = [(7, 100 + i) for i in range(60)] + [(900, 300 + i) for i in range(60)] + [(900, 1200 + i) for i in range(30)] + [(1201, 1300), (3, 1300)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(70)]
    label = brute(pairs)
    alone = {x for x in label if not any(x in p and p[0] != p[1] for p in pairs)}
    found = components.linked(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((x["node"], x["label"]) for x in found) == sorted((k, v) for k, v in label.items() if k not in alone)


def test_graph_components_keep_lone_nodes(spark):
    edges = spark.createDataFrame([("b", "c", 0.5), ("c", "d", 0.1)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert sorted(tuple(r) for r in graph.components(edges, nodes).collect()) == [("a", "a"), ("b", "b"), ("c", "b"), ("d", "b")]
    assert graph.components(edges.limit(0), nodes.limit(0)).count() == 0


def test_keyed_join_of_hub_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", 3)
    rows = spark.range(40).select((F.col("id") % 2 * 5 + F.when(F.col("id") < 4, F.col("id")).otherwise(0)).alias("k"), F.col("id").alias("v"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")).where("k <> 2")
    got = components.with_keyed(rows, keyed, ["k"], "n", 40)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed, "k").collect()))
