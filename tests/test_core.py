"""Golden values, properties and brute force for the people-graph operators."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import replies, scoring
from kinloom.functions import text as ft
from kinloom.operators import catalog, community, graph, layout, pairs, search
from kinloom.plans.analysis import PeopleGraph
from kinloom.plans.plugins import HashedWords, KeywordTuner, safely, tuned
from kinloom.schema import COMPLEMENTARITY_WEIGHTS, ESSENTIAL, FEATURES, SIMILARITY_WEIGHTS, Settings
from kinloom.sources import people, store
from kinloom.streaming import jobs

D, O = SIMILARITY_WEIGHTS, COMPLEMENTARITY_WEIGHTS
GOLDEN = [
    ([0.5] * 6, [0.7] * 6, D, D, 0.572351461868), ([1.0] * 6, [0.1] * 6, D, D, 0.331979899469), ([0.1] * 6, [1.0] * 6, D, D, 0.331979899469),
    ([0.6] * 6, [0.4] * 6, dict.fromkeys(FEATURES, 1.2), dict.fromkeys(FEATURES, 0.8), 0.470680886561),
    ([0.5] * 6, [0.8] + [0.5] * 5, D, dict(zip(FEATURES, [1, 1.2, 1.1, 1.1, 1.2, 0.9])), 0.510320586007),
    ([0.9, 0.4, 0.6, 0.2, 0.7, 0.5], [0.1, 0.8, 0.5, 0.9, 0.3, 0.5], D, O, 0.478605798852), ([0.0] + [0.5] * 5, [0.5] * 6, D, O, 0.115389267975), ([0.5] * 6, [0.0] * 6, D, O, 0.0),
]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_edge_weight_golden(spark):
    cols = [scoring.edge_weight(dict(zip(FEATURES, map(F.lit, s))), dict(zip(FEATURES, map(F.lit, c))), a, b).alias(f"x{k}") for k, (s, c, a, b, _) in enumerate(GOLDEN)]
    got = spark.range(1).select(*cols).first()
    for x, (*_, want) in zip(got, GOLDEN, strict=True):
        assert abs(x - want) < 1e-10
    assert value(spark, scoring.edge_weight({}, {}, D, D)) == 0


def test_power_mean_and_weights(spark):
    v = {"a": F.lit(0.4), "b": F.lit(0.6)}
    assert abs(value(spark, scoring.power_mean(v, 1.0, 0)) - math.sqrt(0.24)) < 1e-12 and abs(value(spark, scoring.power_mean(v, 1.0, 1)) - 0.5) < 1e-12
    assert scoring.normalised({"a": 2, "b": 1, "c": 1}, list("abc")) == {"a": 0.5, "b": 0.25, "c": 0.25}
    assert scoring.normalised({"a": 0, "b": 0}, list("ab")) == {"a": 0.5, "b": 0.5} and scoring.normalised({"a": -1, "b": 1}, list("ab")) == {"a": 0.0, "b": 1.0}
    means = [value(spark, scoring.power_mean({"a": F.lit(0.2), "b": F.lit(0.9)}, 1.0, p)) for p in (-1, 0, 0.5, 1, 2)]
    assert means == sorted(means)
    assert [value(spark, ft.clamp(F.lit(x))) for x in (-0.5, 0.3, 1.5, None)] == [0.0, 0.3, 1.0, None]


def test_tags_and_strip(spark):
    rows = spark.createDataFrame([(" a | b|| c  ",), (None,), ("|",), ("",)], "x string").select(ft.tags(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [["a", "b", "c"], [], [], []]
    rich = spark.createDataFrame([("x, and yes; Data & AI\nthe, ML and Rust",), (None,)], "x string").select(ft.rich_tags(F.col("x")).alias("t")).collect()
    assert [r.t for r in rich] == [["and yes", "data", "rust"], []]
    said = spark.createDataFrame([("Step 3/4",), ("45.5% done",), ("Step 1/0",), (None,), ("?",), ("400%",)], "x string").select(ft.progress(F.col("x")).alias("p")).collect()
    assert [r.p for r in said] == [75.0, 45.5, 0.0, 0.0, 0.0, 100.0]
    assert value(spark, ft.csv_name(F.lit("A.CSV"))) is True


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    r = np.random.default_rng(1)
    pool = [f"skill{i}" for i in range(12)]
    rows = []
    for i in range(14):
        cells = {c: f"{c} {i}" for c in ESSENTIAL[:3]} | {c: (";" if "Persona" in c else " | ").join(r.choice(pool, 3)) for c in ESSENTIAL[3:]}
        rows.append(cells)
    rows[3][ESSENTIAL[4]], rows[5][ESSENTIAL[5]], rows[7][ESSENTIAL[0]], rows[9][ESSENTIAL[1]] = "", "NA", "  ", 'quoted "x"\nline'
    path = tmp_path_factory.mktemp("csv") / "people.csv"
    pd.DataFrame(rows).to_csv(path, index=False)
    return str(path)


def test_csv_scan_and_filter(spark, csv):
    df = people.read_csv(spark, csv)
    assert df.count() == 14 and people.complete(df).count() == 11 and not people.is_empty(df)
    assert {r.column_name: r.rejected for r in people.rejected(df).collect() if r.rejected} == {ESSENTIAL[4]: 1, ESSENTIAL[5]: 1, ESSENTIAL[0]: 1}
    assert people.essentials(df.drop(ESSENTIAL[2]))[1] == [ESSENTIAL[2]]
    assert sorted(r.person_id for r in people.people(df, ["Person Name"]).collect()) == list(range(11))


def test_whole_analysis_and_row_order(spark, csv, tmp_path):
    out = PeopleGraph(spark, HashedWords(32), KeywordTuner()).run(csv, ["Person Name"], "find peers")
    e = {(r.src, r.dst): r.weight for r in out["edges"].collect()}
    assert len(e) == 55 and all(0 <= w <= 1 for w in e.values())
    assert out["insights"].count() == 6 and out["members"].count() in (0, *range(3, 12))
    turned = pd.read_csv(csv, dtype=str, keep_default_na=False).iloc[::-1]
    turned.to_csv(tmp_path / "p.csv", index=False)
    again = PeopleGraph(spark, HashedWords(32), KeywordTuner()).run(str(tmp_path / "p.csv"), ["Person Name"], "find peers")
    assert all(abs(e[r.src, r.dst] - r.weight) < 1e-12 for r in again["edges"].collect())


def matrix(seed, n):
    r = np.random.default_rng(seed)
    w = r.random((n, n))
    w = np.triu(w, 1)
    return w + w.T


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 9))
def test_peeling_is_greedy(seed, n):
    w, alive = matrix(seed, n), list(range(n))
    for x, degree, density in graph.peel_order(w):
        sums = {i: w[i, alive].sum() for i in alive}
        assert x == min(alive, key=lambda i: (round(sums[i], 9), i)) and abs(degree - sums[x]) < 1e-9
        assert abs(density - (sum(sums.values()) / 2 / (len(alive) * (len(alive) - 1) / 2) if len(alive) > 1 else 0)) < 1e-9
        alive.remove(x)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 7))
def test_held_karp_is_the_best_cycle(seed, n):
    w = matrix(seed, n)
    path, total = layout.held_karp(w)
    best = max(sum(w[a, b] for a, b in zip((0, *p), (*p, 0))) for p in itertools.permutations(range(1, n)))
    assert sorted(path) == list(range(n)) and abs(total - best) < 1e-9
    assert abs(sum(w[a, b] for a, b in zip(path, path[1:] + path[:1])) - total) < 1e-9
    assert layout.greedy_cycle(w)[1] <= best + 1e-9


def test_communities_of_two_cliques():
    w = np.full((10, 10), 0.05)
    w[:5, :5] = w[5:, 5:] = 0.9
    np.fill_diagonal(w, 0)
    for name, method in community.METHODS.items():
        assert len(set(method(w)[:5])) == 1 and len(set(method(w)[5:])) == 1 and method(w)[0] != method(w)[9], name
    labels = np.repeat([0, 1], 5)
    m, d = w.sum() / 2, w.sum(axis=1)
    direct = sum(w[i, j] - d[i] * d[j] / (2 * m) for i in range(10) for j in range(10) if labels[i] == labels[j]) / (2 * m)
    assert abs(community.modularity(w, labels) - direct) < 1e-12
    assert abs(community.modularity(w, np.zeros(10, int))) < 1e-12


def test_layout_and_paths():
    d = layout.distances(matrix(3, 8))
    short = layout.floyd_warshall(d)
    assert all(short[i, j] <= short[i, k] + short[k, j] + 1e-12 for i in range(8) for j in range(8) for k in range(8))
    points = np.random.default_rng(1).random((12, 2))
    true = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert layout.smacof(true)[1] < 0.05 and len(layout.circle(5)) == 5


def test_components_and_leaders(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 20) if i % 7 != 6], "src long, dst long, weight double")
    nodes = spark.range(25).withColumnRenamed("id", "node")
    got = {r.node: r.component for r in graph.components(e, nodes).collect()}
    assert got == {i: i - i % 7 if i <= 20 else i for i in range(25)}
    near = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "i long, j long")
    found = {r.id: r.leader for r in search.leaders(spark.range(8), near).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7}


def test_batch_peeling_finds_a_planted_clique(spark):
    rows = [(i, j, 1.0) for i in range(12) for j in range(i + 1, 12)] + [(i, 100 + i * 3 + k, 0.1) for i in range(12) for k in range(3)]
    got = {r.node for r in graph.batch_peeling(spark.createDataFrame(rows, "src long, dst long, weight double"), 0.9).collect()}
    assert got == set(range(12))


def test_ivf_recall_and_exactness(spark, sf):
    from kinloom import queries

    exact = {(r.query_id, r.id) for r in queries.knn_top5(spark, sf).where("query_id % 20 = 0").collect()}
    got = {(r.query_id, r.id) for r in queries.ivf_knn(spark, sf).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


def clustered(spark, n=1200, groups=24, dim=16):
    r = np.random.default_rng(4)
    x = r.normal(size=(groups, dim))[np.arange(n) % groups] + 0.15 * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), x


def test_stored_index_answers_after_it_is_opened_again_and_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 30)  # cells in several parts
    rows, x = clustered(spark)
    index = search.build_index(rows.where("id < 1000"), str(tmp_path / "index"), 12)
    index = search.CellIndex(spark, index.path)
    index.add(rows.where("id >= 1000"))
    assert sum(index.sizes().values()) == 1200
    found = index.search(rows.where("id % 20 = 0"), 5, len(index.centroids)).collect()  # all cells: exact
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    for q in range(0, 1200, 20):
        want = np.lexsort((np.arange(1200), -scores[q]))[:5].tolist()
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == want
    assert index.search(rows.limit(0), 5, 3).count() == 0


def test_rows_read_per_query_fall_with_more_cells(spark, tmp_path):
    rows, x = clustered(spark)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    asked, read = rows.where("id % 20 = 0"), {}
    for cells in (6, 24):
        index = search.build_index(rows, str(tmp_path / str(cells)), cells)
        probes, sizes = index.probes_for(asked, 5, 0.95), index.sizes()
        read[cells] = probes * sum(n * n for n in sizes.values()) / 1200
        got = {(r.query_id, r.id) for r in index.search(asked, 5, probes).collect()}
        want = {(q, i) for q in range(0, 1200, 20) for i in np.lexsort((np.arange(1200), -scores[q]))[:5].tolist()}
        assert len(got & want) >= 0.9 * len(want)
    assert read[24] < 0.5 * read[6]


def test_leaders_equal_the_sequential_pass(spark):
    r = np.random.default_rng(8)
    for n, share in ((60, 0.05), (60, 0.4), (40, 0.0)):
        near = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < share] + [(0, j) for j in range(1, n) if share == 0.4]
        lead, of = [], {}
        for x in range(n):
            of[x] = next((i for i in lead if (i, x) in set(near)), x)
            if of[x] == x:
                lead.append(x)
        pairs_ = spark.createDataFrame(near, "i long, j long")
        assert {q.id: q.leader for q in search.leaders(spark.range(n), pairs_).collect()} == of
    chain = spark.range(20).selectExpr("id as i", "id + 1 as j")
    assert {q.id: q.leader for q in search.leaders(spark.range(21), chain).collect()} == {x: x - x % 2 for x in range(21)}


def test_quantile_equals_linear_interpolation(spark, monkeypatch):
    from kinloom.operators import selection

    r = np.random.default_rng(2)
    inf, nan = float("inf"), float("nan")
    cases = [r.random(500), r.normal(size=300) * 1e300, np.r_[np.zeros(90), r.random(10) * 1e-300], np.r_[1e308, -1e308, 5.0], np.array([3.0]), np.repeat([1.0, 2.0, 5.0], 40)]
    for bins in (4096, 3):
        monkeypatch.setattr(selection, "BINS", bins)
        for x in cases:
            df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (nan,), (inf,), (-inf,)], "w double")
            for q in (0.0, 0.1, 0.5, 0.9, 1.0):
                assert selection.quantile(df, "w", q) == pytest.approx(np.quantile(x / 4, q) * 4, rel=1e-12)
    assert selection.quantile(spark.createDataFrame([(None,)], "w double"), "w", 0.5) is None


def test_percentile_filter_has_no_gathering_aggregate(spark, sf):
    from kinloom.operators import graph

    e = spark.createDataFrame([(i, i + 1, i / 7) for i in range(100)], "src long, dst long, weight double")
    kept = graph.above_percentile(e, 90)
    assert sorted(r.src for r in kept.collect()) == list(range(90, 100))
    assert "percentile" not in kept._jdf.queryExecution().toString().lower()


def test_grid_meets_every_pair_once(spark, monkeypatch):
    from kinloom.operators import grid

    assert grid.strips(10**6, 480, 4000) == 89 and grid.strips(10**9, 480, 16) > 7000
    monkeypatch.setattr(grid, "TILE", 7)
    r = np.random.default_rng(1)
    x = r.normal(size=(101, 3))
    df = spark.createDataFrame([(i * 5 - 30, v.tolist(), 1) for i, v in enumerate(x)], "person_id long, v array<double>, _cell int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for most in (1 << 26, 200):  # strips by tasks, and by memory
        monkeypatch.setattr(grid, "STRIP_BYTES", most)
        found = {(q.i, q.j): q.v for q in pairs.similarities(df, ["v"]).collect()}
        assert len(found) == 101 * 50 and all(abs(found[i * 5 - 30, j * 5 - 30] - unit[i] @ unit[j]) < 1e-12 for i in range(101) for j in range(i + 1, 101))
        sums = pairs.threshold_sums(df, "v").first()
        assert sums["n"] == 5050 and abs(sums["total"] - np.triu(unit @ unit.T, 1).sum()) < 1e-9
        near = search.nearest(df.selectExpr("person_id as id", "v as vector"), df.selectExpr("person_id as id", "v as vector"), 4).collect()
        assert len(near) == 404
    assert pairs.similarities(df.limit(0), ["v"]).count() == 0 and pairs.similarities(df.limit(1), ["v"]).count() == 0


@pytest.mark.parametrize("deal", [4096, 5])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, deal):
    """A tag that nearly all have, empty and null sets, repeated tags, at several thresholds."""
    monkeypatch.setattr(pairs, "DEAL", deal)
    r = np.random.default_rng(3)
    sets = {i: ["all"] * (i % 9 > 0) + [f"t{x}" for x in r.integers(0, 12, r.integers(0, 6))] for i in range(40)} | {40: ["all", "t1", "t2"], 41: ["t2", "t1", "all"]}
    df = spark.createDataFrame([*sets.items(), (99, None), (98, [])], "who long, tags array<string>")
    for t in (0.0, 0.3, 0.5, 0.75, 1.0):
        want = {}
        for i, j in itertools.combinations(sets, 2):
            x, y = set(sets[i]), set(sets[j])
            if x & y and len(x & y) / len(x | y) >= t:
                want[i, j] = len(x & y) / len(x | y)
        got = {(q.i, q.j): q.jaccard for q in pairs.jaccard(df, "who", "tags", t).collect()}
        assert got == pytest.approx(want), t


@pytest.mark.parametrize("kind", ["long", "string"])
def test_crowded_jaccard_shuffles_no_pairs(spark, monkeypatch, kind):
    """Frequent tags (as jaccard_pairs): the kernel finds what the join finds, without the join."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [f"t{x}" for x in r.integers(0, 6, 4)] + [None] * (i % 5 == 0)) for i in range(60)], "who long, tags array<string>").selectExpr(f"cast(who AS {kind}) AS who", "tags")
    found = []
    for crowded in (0, 32):
        monkeypatch.setattr(pairs, "CROWDED", crowded)
        out = pairs.jaccard(df, "who", "tags")
        assert ("Join" in out._jdf.queryExecution().executedPlan().toString()) == (crowded == 0)
        found.append({(q.i, q.j): q.jaccard for q in out.collect()})
    assert found[1] == pytest.approx(found[0]) and len(found[0]) > 1000


def test_nearest_orders_few_scores(monkeypatch):
    """The k best are those of all scores, ties by id, but only scores that may be among them are ordered."""
    r, seen, sort = np.random.default_rng(6), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: seen.append(np.asarray(keys[0]).size) or sort(keys, axis=axis))
    for x in (r.standard_normal((3000, 6)), r.integers(-3, 4, (3000, 6)).astype(float)):
        for least in (None, 3.0):
            cell = search._Nearest(0, 5, least)
            tiles = [pa.RecordBatch.from_arrays([pa.array(np.arange(s, min(s + 256, 3000))), pa.array(list(x[s : s + 256]))], ["id", "vector"]) for s in range(0, 3000, 256)]
            for side in (cell.left, cell.right):
                for t in tiles:
                    list(side(t) or ())
            got = sorted((q, i) for b in cell.end() for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            scores = np.round(x @ x.T, 10)
            np.fill_diagonal(scores, -np.inf)
            best = sort((np.broadcast_to(np.arange(3000), scores.shape), -scores), axis=1)[:, :5]
            assert got == sorted((q, int(i)) for q in range(3000) for i in best[q] if least is None or scores[q, i] >= least)
    assert sum(seen) < 4 * 3000 * 3000 / 3


def test_tfidf_pairs_are_counted_by_masks(spark, monkeypatch):
    """The pairs that share a term and the sum of their products, as by all pairs, while few masks meet."""
    from kinloom.operators import insights

    monkeypatch.setattr(insights, "MASK_BITS", 7)
    monkeypatch.setattr(insights.grid, "TILE", 9)
    r = np.random.default_rng(12)
    w = r.random((160, 18)) * (r.random((160, 18)) < 0.12)
    w[:40, 9:] = 0
    w[40:80, :9] = 0
    w[5:9] = w[4]
    df = spark.createDataFrame([(int(i), f"t{j}", float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "doc_id long, term string, weight double")
    both = (w @ w.T)[np.triu_indices(160, 1)]
    found = insights.pair_sums(df, "doc_id", 18).first()
    assert found["pairs"] == (both > 0).sum() and found["total"] == pytest.approx(both.sum())
    assert tuple(insights.pair_sums(df.limit(0), "doc_id", 18).first()) == (0, None)
    monkeypatch.setattr(pairs, "threshold_sums", lambda *_, **__: pytest.fail("all pairs met"))
    from kinloom import queries

    assert queries.QUERIES["tfidf_similarity"](spark, "/root/testdata/sf0.001").count() == 1


def test_dedup_mapping_makes_no_rows_of_far_pairs(spark, sf, monkeypatch):
    from kinloom import queries

    rows = queries._rows(spark, sf).withColumnRenamed("id", "person_id")
    want = pairs.similarities(rows, ["vector"]).where("vector >= 0.3").select("i", "j").collect()
    assert sorted(pairs.near(rows, "vector", 0.3).collect()) == sorted(want) and want
    monkeypatch.setattr(pairs, "similarities", lambda *_, **__: pytest.fail("all pairs as rows"))
    assert queries.QUERIES["dedup_mapping"](spark, sf).count() == rows.count()


def test_shuffled_rows_grow_with_the_grids_sides(spark):
    """Each row goes to every strip of the grid once: rows x (sides + 1), not rows x rows / tile."""
    from kinloom.operators import grid

    df = spark.range(5000).selectExpr("id as person_id", "array(double(id % 7), 1D) as v")
    seen = spark.sparkContext.accumulator(0)

    sides = 5
    rows = df.withColumn("s", (F.col("person_id") * sides / 5000).cast("int"))
    out = grid.triangle(rows, F.col("s"), sides, ["person_id"], lambda b: seen.add(len(b)), lambda a, b, k: pa.RecordBatch.from_arrays([pa.array([int(k.sum())])], ["n"]), "n long")
    assert out.agg(F.sum("n")).first()[0] == 5000 * 4999 // 2
    assert seen.value == 5000 * (sides + 1)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_ivf_recall_of_nine_tenths(spark, size):
    from kinloom import queries

    exact = {(r.query_id, r.id) for r in queries.knn_top5(spark, f"/root/testdata/{size}").where("query_id % 20 = 0").collect()}
    got = {(r.query_id, r.id) for r in queries.ivf_knn(spark, f"/root/testdata/{size}").collect()}
    assert len(exact & got) >= 0.9 * len(exact) and len(got) == len(exact)


def test_complementarity_direction_and_default(spark):
    wide = spark.createDataFrame([(0, "a", "x"), (1, "b", ""), (2, "c", "x")], "person_id long, f string, g string")
    scores = spark.createDataFrame([("f", "a", "b", 0.9), ("f", "c", "a", 0.2), ("g", "x", "x", 0.0)], "category string, target string, comparison string, score double")
    ij = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "i long, j long")
    got = {(r.i, r.j): (r.c_f, r.c_g) for r in pairs.complementarities(ij, wide, scores, ["f", "g"]).collect()}
    assert got == {(0, 1): (0.9, 0.5), (0, 2): (0.2, 0.0), (1, 2): (0.5, 0.5)}


def test_minmax_of_constants(spark):
    df = spark.createDataFrame([(0, 1, 0.3, 1.0), (0, 2, 0.3, 3.0)], "i long, j long, a double, b double")
    assert [(r.a, r.b) for r in pairs.minmax(df, ["a", "b"]).orderBy("j").collect()] == [(0.5, 0.0), (0.5, 1.0)]


def test_reply_parsing():
    names = ["alpha", "beta"]
    assert replies.single('{"alpha": 0.1, "beta": 1}', names) == {"alpha": 0.1, "beta": 1.0}
    assert replies.single('sure ```json\n{"alpha": 0.3}\n``` done', names) == {"alpha": 0.3, "beta": 0.5}
    assert replies.single("alpha: 0.7\n- beta = 0.2", names) == {"alpha": 0.7, "beta": 0.2}
    assert replies.single("nothing", names) == {"alpha": 0.5, "beta": 0.5} and replies.single('{"alpha": 7}', names)["alpha"] == 0.5
    both = {"t1": {"alpha": 0.1, "beta": 0.5}, "t2": {"alpha": 0.5, "beta": 0.9}}
    assert replies.batch("x " + json.dumps({"t1": {"alpha": 0.1}, "t2": {"beta": 0.9}}) + " y", ["t1", "t2"], names) == both
    assert replies.batch("Target t1\nalpha: 0.1\nTarget t2\nbeta: 0.9", ["t1", "t2"], names) == both


class Broken:
    dimensions = 3

    def embed(self, texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError("no")
        return [[1.0, 2.0, 3.0]] if texts[0] != "short" else [[1.0]]


def test_embedding_fallback_and_tuner():
    assert safely(Broken(), ["a", "bad", "short"]) == [[1.0, 2.0, 3.0], None, None] and safely(Broken(), []) == []
    defaults = (dict(D), dict(O))
    assert tuned(KeywordTuner(), "  ") == defaults and tuned(None, "x") == defaults and tuned(KeywordTuner(), None) == defaults
    s, c = tuned(KeywordTuner(), "hire complementary partners")
    assert s == D and c["experience"] == 2.0

    class Odd:
        def tune(self, prompt, context):
            return {"role": 3.5, "market": -1}, {}

    assert tuned(Odd(), "x")[0] == {**D, "role": 2.0, "market": 0.0}


def test_store(spark, tmp_path):
    e = spark.createDataFrame([("a:1", "x"), ("a:2", "y"), ("b:1", "z")], "key string, value string")
    assert {r.key for r in store.without_keys(e, "a:*").collect()} == {"b:1"} and store.with_keys(e, "a:*").count() == 2
    members = spark.createDataFrame([("s", "m"), ("s", "n")], "key string, member string")
    assert store.set_remove(store.set_add(members, members), members.limit(1)).count() == 1
    edges = spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, weight double")
    assert store.links_from_json(store.links_json(edges)).collect() == edges.collect()
    store.save_graph(spark.range(2), edges, str(tmp_path / "g"))
    assert store.load_graph(spark, str(tmp_path / "g"))[1].collect() == edges.collect()
    store.save_version(edges, str(tmp_path), "v1")
    assert store.load_version(spark, str(tmp_path), "v1").count() == 1
    now = F.lit("2024-01-02").cast("timestamp")
    t = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-03"), ("c", None)], "key string, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    assert {r.key for r in store.live(t, now).collect()} == {"b", "c"}


def test_streamed_status_equals_batch(spark, sf, tmp_path):
    from kinloom import queries

    events = queries._job_events(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    events.repartition(6).write.parquet(str(tmp_path / "events"))
    stream = jobs.event_stream(spark, str(tmp_path / "events"), events.schema, 2)
    seen = {}

    def send(batch, _):
        seen.update({r.job_id: (r.at, r.status) for r in batch.select("job_id", "at", "status").collect()})

    jobs.deliver(jobs.latest_status(stream, "365 days"), send, str(tmp_path / "check")).awaitTermination(120)
    want = {r.job_id: r.at for r in events.groupBy("job_id").agg(F.max("at").alias("at")).collect()}
    assert {k: v[0] for k, v in seen.items()} == want


def test_settings_take_zero():
    assert Settings(min_density=0.0).min_density == 0.0


def test_shape_ignores_row_order(spark):
    df = spark.range(50).withColumn("x", F.when(F.col("id") % 2 == 0, F.col("id")))
    assert catalog.shape(df).collect() == catalog.shape(df.orderBy(F.desc("id"))).collect()
