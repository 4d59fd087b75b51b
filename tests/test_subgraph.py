"""Plugins, catalogue writes, the stored-version fallback and the report on a subgraph."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom import queries
from kinloom.operators import catalog, community, graph, insights, layout, pair_graph, pairs, subgraph, vector_store
from kinloom.plans.analysis import PeopleGraph
from kinloom.plans.plugins import HashedWords, scored_by, selected
from kinloom.schema import ESSENTIAL, OPTIONAL, Settings
from kinloom.sources import store


class Lengths:
    """Replies with a JSON score by length difference; fails for one target."""

    def reply(self, category, targets, comparisons):
        if "bad" in targets:
            raise RuntimeError("no answer")
        return "well: " + json.dumps({t: {c: min(1.0, abs(len(t) - len(c)) / 10) for c in comparisons} for t in targets})


def test_scorer_in_batches(spark):
    rows = [("f", "x" * n) for n in range(1, 20)] + [("g", "bad"), ("g", "good"), ("g", ""), ("g", None), ("g", "good")]
    got = {(r.category, r.target, r.comparison): r.score for r in scored_by(Lengths(), spark.createDataFrame(rows, "feature string, profile string"), 8).collect()}
    assert len(got) == 19 * 19 + 4
    assert all(got["f", "x" * a, "x" * b] == (0.0 if a == b else pytest.approx(min(1.0, abs(a - b) / 10))) for a in range(1, 20) for b in range(1, 20))
    assert got["g", "bad", "good"] == 0.5 == got["g", "good", "bad"] and got["g", "good", "good"] == 0.0


def test_selector(spark):
    class Longest:
        def select(self, tags):
            if "boom" in tags:
                raise RuntimeError
            return "none of them" if "odd" in tags else max(tags, key=len)

    rows = [(1, "a"), (1, "a"), (1, "longer"), (2, "boom"), (2, "bb"), (2, "bb"), (3, "odd"), (4, "alone")]
    out = {r.c: r.umbrella for r in selected(Longest(), spark.createDataFrame(rows, "c long, tag string"), ["c"]).collect()}
    assert out == {1: "longer", 2: "bb", 3: "odd", 4: "alone"}


def test_catalogue_writes(spark):
    versions = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2), ("b", "v3", 1)], "file_id string, version_id string, version_number int")
    more = catalog.with_version(versions, spark.createDataFrame([("a", "v5"), ("a", "v4"), ("c", "v6")], "file_id string, version_id string"))
    assert sorted((r.file_id, r.version_id, r.version_number) for r in more.collect())[2:] == [("a", "v4", 3), ("a", "v5", 4), ("b", "v3", 1), ("c", "v6", 1)]
    assert [r.version_id for r in catalog.versions_of(more, "a").collect()] == ["v1", "v2", "v4", "v5"]
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "file_id string, filename string")
    files, versions = catalog.with_file_added(files, versions, spark.createDataFrame([("d", "z", "v9")], "file_id string, filename string, current_version_id string"))
    assert files.count() == 3 and versions.where("file_id = 'd'").first().version_number == 1
    files, versions = catalog.without_files(files, versions, spark.createDataFrame([("a",), ("a",)], "file_id string"))
    assert sorted(r.file_id for r in files.collect()) == ["b", "d"] and versions.count() == 2
    jobs = spark.createDataFrame([("1", "running"), ("2", "failed"), ("3", "completed"), ("4", "pending")], "job_id string, status string")
    at = F.lit("2030-01-01").cast("timestamp")
    assert sorted(r.job_id for r in catalog.cancelled(jobs, at).collect()) == ["1", "4"] and [r.job_id for r in catalog.restarted(jobs, at).collect()] == ["2"]
    events = jobs.withColumn("at", at)
    state = jobs.withColumn("created_at", F.lit("2020-01-01").cast("timestamp"))
    assert sorted(r.job_id for r in catalog.without_old(events, state, at, 30).collect()) == ["1", "4"]


def test_version_falls_back_to_a_path(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/root/version_id=a")
    spark.range(2).write.parquet(f"{tmp_path}/other")
    read = lambda v, p: store.load_version_or_path(spark, f"{tmp_path}/root", v, p, "id long").count()
    assert (read("a", None), read("b", f"{tmp_path}/other"), read("b", f"{tmp_path}/none"), read("b", None)) == (3, 2, 0, 0)


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, vector array<double>")
    base = vector_store.appended(spark.createDataFrame([], "id long, name string, vector array<double>"), rows, ["name"])
    more = vector_store.appended(base, rows.withColumn("name", F.concat("name", F.lit("2"))), ["name"])
    vector_store.save(more, f"{tmp_path}/v")
    back = vector_store.load(spark, f"{tmp_path}/v")
    assert sorted((r.id, r.name) for r in back.collect()) == [(0, "a"), (1, "b"), (2, "a2"), (3, "b2")] and vector_store.size(back) == 4
    assert {(r.query_id, r.id): r.score for r in vector_store.inner_products(back, [0, 2]).collect()} == {(0, 2): 1.0, (2, 0): 1.0}
    assert vector_store.inner_products(back, []).count() == 12
    texts = spark.createDataFrame([(0, "red apple"), (1, "green pear"), (2, "red pear")], "id long, t string")
    own = spark.createDataFrame([(r.id, v) for r, v in zip(texts.collect(), HashedWords(64).embed(["red apple", "green pear", "red pear"]), strict=True)], "id long, vector array<double>")
    got = vector_store.text_search(own, spark.createDataFrame([("apple red",)], "query string"), HashedWords(64), 1).first()
    assert (got.query, got.id) == ("apple red", 0) and abs(got.score - 1) < 1e-9


def test_score_table_in_the_pair_kernel(spark, monkeypatch):
    """The kernel's lookup and the joined form give the same, with empty and unknown profiles and one-sided scores."""
    r = np.random.default_rng(3)
    names = ["a", "b", "c", "", None, "unseen"]
    rows = [(i, r.random(3).tolist(), r.random(3).tolist(), names[i % 6], names[(i // 2) % 6]) for i in range(40)]
    who = spark.createDataFrame(rows, "person_id long, f array<double>, g array<double>, pf string, pg string")
    scores = spark.createDataFrame([("f", "a", "b", 0.9), ("f", "b", "a", 0.3), ("f", "c", "a", 0.2), ("g", "a", "a", 0.0), ("g", "c", "b", 0.7), ("g", "", "b", 0.1)], "category string, target string, comparison string, score double")
    got = sorted(map(tuple, pairs.scored_pairs(who, {"f": "pf", "g": "pg"}, scores).collect()))
    monkeypatch.setattr(pairs, "LOOKUP_SCORES", 0)
    assert sorted(map(tuple, pairs.scored_pairs(who, {"f": "pf", "g": "pg"}, scores).collect())) == got and len(got) == 780
    monkeypatch.undo()
    plan = pairs.scored_pairs(who, {"f": "pf", "g": "pg"}, scores)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0  # neither scores nor vectors are joined
    assert pairs.scored_pairs(who, {"f": "pf", "g": "pg"}, scores.limit(0)).where("c_f <> 0.5").count() == 0


def test_prefixes_and_subgroups(spark):
    w = {(0, 1): 0.9, (0, 2): 0.8, (1, 2): 0.9, (3, 4): 0.9, (3, 5): 0.7, (4, 5): 0.8, (2, 3): 0.1, (5, 6): 0.05}
    edges = spark.createDataFrame([(*k, v) for k, v in w.items()], "src long, dst long, weight double")
    nodes = spark.range(7).select(F.col("id").alias("node"))
    found = {r.prefix: (r.size, r.density) for r in subgraph.prefixes(graph.peeling(edges), 0.3).collect()}
    assert all(size >= 3 and density >= 0.3 for size, density in found.values()) and max(found) == 4
    groups = subgraph.subgroups(edges, nodes)
    strong = subgraph.subgroup_strength(edges, groups)
    assert [r["size"] for r in strong.orderBy("place").collect()] in ([3, 3], [3, 4], [4, 3])
    assert subgraph.subgroup_summary(strong).first().total_subgroups == 2
    assert subgraph.subgroups(edges, nodes.limit(3)).count() == 0
    large = {r.node: r.community for r in subgraph.subgroups(edges, nodes, Settings(dense_nodes=5)).collect()}
    assert large[0] == large[1] == large[2] != large[3] == large[4] == large[5]  # on tables as well
    for dense_above in (0.0, 0.9):
        found, scores = subgraph.communities(edges, nodes, Settings(dense_above=dense_above))
        methods = {r.method for r in found.select("method").distinct().collect()}
        assert ("hierarchical" in methods) == (dense_above == 0.0) and scores.where("chosen").count() == 1


def test_live_and_filled_scores(spark):
    own = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "b"), ("g", "a")], "feature string, profile string")
    scores = spark.createDataFrame([("f", "a", "b", 0.4), ("f", "a", "gone", 0.9), ("g", "a", "b", 0.1)], "category string, target string, comparison string, score double")
    assert [tuple(r) for r in insights.live_scores(scores, own).select("category", "target", "comparison").collect()] == [("f", "a", "b")]
    got = {(r.category, r.target, r.comparison): (r.score, r.scaled) for r in insights.filled_scores(scores, own).collect()}
    assert got == {("f", "a", "a"): (0, 0), ("f", "a", "b"): (0.4, 1), ("f", "b", "a"): (0, 0), ("f", "b", "b"): (0, 0), ("g", "a", "a"): (0, 0.5)}


def test_whole_report(spark, tmp_path):
    import pandas as pd

    r = np.random.default_rng(1)
    words = ["seed", "growth", "health", "finance", "lead", "junior", "design", "sales"]
    cell = lambda: "|".join(r.choice(words, 2))
    names = [c for c in ESSENTIAL if c not in OPTIONAL]
    people = pd.DataFrame([{c: f"P{i}" if c == "Person Name" else cell() for c in names} | {"LinkedIn URL": f"u{i}"} for i in range(14)])
    people.to_csv(tmp_path / "p.csv", index=False)
    for s in (Settings(), Settings(dense_nodes=2, batch_peeling=0.1)):
        out = PeopleGraph(spark, HashedWords(32), settings=s).run(str(tmp_path / "p.csv"), ["Person Name"])
        counts = {k: v.count() for k, v in out.items()}
        n = counts["members"]
        assert n >= 3 and counts["member_list"] == n and counts["absent"] == 0 and counts["named_edges"] == n * (n - 1) / 2
        assert counts["importance"] == counts["importance_report"] == counts["complementarity"] == counts["hybrid"] == 6 and counts["dominance"] == 1
        assert counts["replication"] and counts["centroid_report"] and counts["communities"] in (0, n)  # 0: no method divides the graph
        assert ("layout" in out) == (n <= s.dense_nodes)
    assert all(r.line.startswith(f"{r.rank}. ") for r in out["importance_report"].collect())


def _all_minima(distance, clusters):
    """Average linkage that looks at all pairs in every step."""
    groups = [[x] for x in range(len(distance))]
    while len(groups) > clusters:
        _, a, b = min((np.mean([distance[x, y] for x in p for y in q]), a, b) for a, p in enumerate(groups) for b, q in enumerate(groups) if a < b)
        groups[a] += groups.pop(b)
    return sorted(map(sorted, groups))


@pytest.mark.parametrize("seed", range(4))
def test_linkage_by_row_minima_equals_all_pairs(seed):
    d = np.random.default_rng(seed).random((23, 23))
    d = np.triu(d, 1) + np.triu(d, 1).T
    for k, labels in zip((2, 5, 9), community.linkage_levels(d, [2, 5, 9]), strict=True):
        assert sorted([np.flatnonzero(labels == c).tolist() for c in range(k)]) == _all_minima(d, k)


def test_leading_vectors_without_all_of_them(monkeypatch):
    r = np.random.default_rng(3)
    w = np.kron(np.eye(4), np.ones((30, 30))) + 0.05 * r.random((120, 120))
    w = w + w.T
    exact = community.leading(w, 4)
    monkeypatch.setattr(community, "EIGEN_NODES", 50)
    monkeypatch.setattr(community, "EIGEN_STEPS", 60)
    assert np.linalg.svd(exact.T @ community.leading(w, 4))[1] == pytest.approx(np.ones(4), abs=1e-6)


def test_communities_of_pairs_are_those_of_the_edges_without_an_edge_table(spark, sf, monkeypatch):
    own = queries._graph(spark, sf).only(spark.range(60).withColumnRenamed("id", "node"))
    for above in (0.3, 0.9):
        want = [sorted(map(tuple, x.collect())) for x in subgraph.communities(own.edges(), own.rows.selectExpr("id AS node"), Settings(dense_above=above))]
        with monkeypatch.context() as m:
            m.setattr(pair_graph.PairGraph, "edges", lambda *_: pytest.fail("edges as rows"))
            m.setattr(pair_graph.PairGraph, "blocks", lambda *_: pytest.fail("pairs of communities as rows"))
            got = [sorted(map(tuple, x.collect())) for x in subgraph.communities_of_pairs(own, Settings(dense_above=above))]
        assert got[0] == want[0]
        assert [r[::2] for r in got[1]] == [r[::2] for r in want[1]]
        assert [r[1] for r in got[1]] == pytest.approx([r[1] for r in want[1]])


def test_communities_of_groups_are_those_of_each_and_leave_no_row_out(spark, sf):
    every = queries._graph(spark, sf)
    groups = spark.range(90).selectExpr("id AS node", "IF(id < 50, 7L, 3L) AS `group`")
    for above in (0.3, 0.9):
        found, scores = (x.collect() for x in subgraph.communities_of_groups(every, groups, Settings(dense_above=above)))
        for g in (3, 7):
            own = every.only(groups.where(f"`group` = {g}"))
            want = [sorted(map(tuple, x.collect())) for x in subgraph.communities_of_pairs(own, Settings(dense_above=above))]
            assert sorted((r.method, r.node, r.community) for r in found if r.group == g) == want[0]
            got = sorted((r.method, r.score, r.chosen) for r in scores if r.group == g)
            assert [r[::2] for r in got] == [r[::2] for r in want[1]]
            assert [r[1] for r in got] == pytest.approx([r[1] for r in want[1]])


def test_people_communities_divide_all_people(spark, sf):
    found = queries.QUERIES["people_communities"](spark, sf)
    assert found.select("node").distinct().count() == 500
    assert found.groupBy("node").count().where("count <> 4").isEmpty()
    assert found.where("chosen").select("label").distinct().count() == 10


def test_the_layout_on_tables_is_that_of_the_matrix(spark, sf):
    own = queries._graph(spark, sf).only(spark.range(45).withColumnRenamed("id", "node"))
    want = {r.node: (r.x, r.y, r.stress) for r in layout.stress_layout(own.edges()).collect()}
    for dense in (10_000, 10):
        got = {r.node: (r.x, r.y, r.stress) for r in layout.stress_layout_of_pairs(own, dense, rounds=300).collect()}
        assert got.keys() == want.keys()
        assert [got[k] for k in sorted(got)] == [pytest.approx(want[k], abs=1e-6) for k in sorted(want)]


@pytest.mark.parametrize("name", ["people_paths", "people_layout", "people_subgroups"])
def test_people_of_a_label_without_an_edge_table(spark, sf, monkeypatch, name):
    monkeypatch.setattr(pair_graph.PairGraph, "edges", lambda *_, **__: pytest.fail("edges as rows"))
    assert not queries.QUERIES[name](spark, sf).isEmpty()


def test_subgroups_of_pairs_are_those_of_the_edges(spark, sf):
    own = queries._graph(spark, sf).only(spark.range(60).withColumnRenamed("id", "node"))
    nodes, edges = own.rows.selectExpr("id AS node"), subgraph.written(own.edges(), "edges")
    for most in (10_000, 10):
        want = sorted(map(tuple, subgraph.subgroups(edges, nodes, Settings(dense_nodes=most)).collect()))
        assert sorted(map(tuple, subgraph.subgroups_of_pairs(own, Settings(dense_nodes=most)).collect())) == want
