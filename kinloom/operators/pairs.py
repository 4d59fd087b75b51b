"""All i < j pairs of people, their similarities, complementarities and edges.

The pair count is quadratic by definition; what must not be is anything else.
People are dealt over a triangular grid of tasks (operators/grid.py), where a
numpy kernel emits the pairs of two tiles as Arrow columns: a person's vectors
are copied once for each strip of the grid, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.scoring import blended, means
from kinloom.operators import grid
from kinloom.operators.components import with_keyed
from kinloom.schema import COMPLEMENTARITY_WEIGHTS, SIMILARITY_WEIGHTS, Settings
from kinloom.scratch import written

#: Scores that a pair kernel looks up itself.
LOOKUP_SCORES = 1_000_000


def unit_matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix, each of length 1 (zero vectors stay 0)."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _strip(people: DataFrame, key: str, vectors: Sequence[str]) -> tuple[Column, int]:
    """The strip of each row, consecutive ids together, and the number of strips, by the counted rows and their size."""
    size = sum((F.max(F.size(v)) for v in vectors), F.lit(0))
    n, low, high, width = people.agg(F.count(key), F.min(key), F.max(key), size).first()
    sides = grid.strips(n, 8 * (width or 1), grid.tasks_of(people)) if n else 1
    return F.floor((F.col(key) - F.lit(low or 0)) * sides / F.lit((high or 0) - (low or 0) + 1)), sides


def similarities(people: DataFrame, vectors: Sequence[str], key: str = "person_id") -> DataFrame:
    """(i, j, one cosine column for each vector column) of all i < j; 0 where a norm is 0."""
    return _pairs(people, vectors, {}, None, 0.0, key)


@dataclass
class ScoreTable:
    """Complementarity scores for lookup in a pair kernel: by category the sorted profile codes, and sorted keys (target, comparison) with their scores."""

    codes: dict[str, np.ndarray]
    keys: dict[str, np.ndarray]
    values: dict[str, np.ndarray]

    @staticmethod
    def of(rows: pd.DataFrame) -> ScoreTable:
        """From (category, t, c, score) with profile codes; a missing direction takes the score of the other."""
        out = ScoreTable({}, {}, {})
        for f, own in rows.groupby("category"):
            t, c, s = own["t"].to_numpy(), own["c"].to_numpy(), own["score"].to_numpy(float)
            codes = np.unique(np.concatenate((t, c)))
            t, c = np.searchsorted(codes, t), np.searchsorted(codes, c)
            keys = np.concatenate((t * len(codes) + c, c * len(codes) + t))
            keys, first = np.unique(keys, return_index=True)  # of a score and one turned round the first, its own
            out.codes[f], out.keys[f], out.values[f] = codes, keys, np.concatenate((s, s))[first]
        return out

    def places(self, f: str, codes: np.ndarray) -> np.ndarray:
        """The number of each profile code, -1 where no score has it."""
        known = self.codes.get(f, np.zeros(0, np.int64))
        if not len(known):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, at, -1)

    def scores(self, f: str, left: np.ndarray, right: np.ndarray, default: float) -> np.ndarray:
        """(left x right) scores of profile numbers; each distinct pair is looked up once."""
        a, of_a = np.unique(left, return_inverse=True)
        b, of_b = np.unique(right, return_inverse=True)
        out = np.full((len(a), len(b)), default)
        keys = self.keys.get(f, np.zeros(0, np.int64))
        if len(keys):
            want = a[:, None] * len(self.codes[f]) + b[None, :]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[at] == want) & (a >= 0)[:, None] & (b >= 0)[None, :]
            out[hit] = self.values[f][at[hit]]
        return out[of_a][:, of_b]


def scaled_similarities(people: DataFrame, vectors: Sequence[str], key: str = "person_id") -> DataFrame:
    """As minmax of similarities, without a table of them: a first pass of the kernel finds the spans, a second one makes and scales the cosines."""
    people = written(people, "people")
    names = list(vectors)

    def pair(left, right, keep):
        own = [(x @ y.T)[keep] for x, y in zip(left, right, strict=True)] if keep.any() else []
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array([float(x.min()) for x in own]), pa.array([float(x.max()) for x in own])], schema=pa.schema([("k", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]))

    strip, sides = _strip(people, key, names)
    rows = people.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(v).cast("array<double>").alias(v) for v in names], strip.alias("_at"))
    found = grid.triangle(rows, F.col("_at"), sides, ["id"], lambda r: [unit_matrix(r.column(v)) for v in names], pair, "k long, low double, high double")
    spans = {names[r["k"]]: (r["low"], r["high"]) for r in found.groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    return _pairs(people, names, {}, None, 0.0, key, spans)


def lookups(people: DataFrame, profiles: dict[str, str], scores: DataFrame, key: str = "person_id", default: float = 0.5) -> DataFrame:
    """(i, j, c_<feature>) as scored_pairs, without a cosine."""
    if usable(scores).count() > LOOKUP_SCORES:
        return scored_pairs(people, profiles, scores, key, default).drop(*profiles)
    return _pairs(coded(people, profiles, key), [], {f: f"_code_{f}" for f in profiles}, score_table(scores), default, key)


def _scaled(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return (x - low) / (high - low) if high > low else np.full_like(x, 0.5)


def _pairs(people: DataFrame, vectors: Sequence[str], codes: dict[str, str], table: ScoreTable | None, default: float, key: str, spans: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    names, marks = list(vectors), dict(codes)
    shared = people.sparkSession.sparkContext.broadcast(table) if marks else None

    def prepare(rows: pa.RecordBatch):
        places = {f: shared.value.places(f, rows.column(c).fill_null(0).to_numpy()) for f, c in marks.items()}
        return rows.column("id").to_numpy(), [unit_matrix(rows.column(v)) for v in names], places

    def pair(left, right, keep):
        if keep.all():
            own = lambda m: m.ravel()
            ends = np.repeat(left[0], keep.shape[1]), np.tile(right[0], keep.shape[0])
        else:
            i, j = np.nonzero(keep)
            own = lambda m: m[i, j]
            ends = left[0][i], right[0][j]
        columns = [own(x @ y.T) for x, y in zip(left[1], right[1], strict=True)]
        if spans:
            columns = [_scaled(c, *spans[n]) for n, c in zip(names, columns, strict=True)]
        columns += [own(shared.value.scores(f, left[2][f], right[2][f], default)) for f in marks]
        return pa.RecordBatch.from_arrays([*map(pa.array, ends), *map(pa.array, columns)], ["i", "j", *names, *(f"c_{f}" for f in marks)])

    strip, sides = _strip(people, key, names)
    rows = people.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(v).cast("array<double>").alias(v) for v in names], *[F.col(c).cast("long").alias(c) for c in marks.values()], strip.alias("_at"))
    fields = [f"`{n}` double" for n in (*names, *(f"c_{f}" for f in marks))]
    return grid.triangle(rows, F.col("_at"), sides, ["id"], prepare, pair, ", ".join(["i long, j long", *fields]))


def _code(category, profile) -> Column:
    """The number of a profile in the kernel: a 64-bit hash, 0 for an empty one, which has no score."""
    return F.when(F.coalesce(profile, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(category, profile))


def scored_pairs(people: DataFrame, profiles: dict[str, str], scores: DataFrame, key: str = "person_id", default: float = 0.5) -> DataFrame:
    """(i, j, a cosine <feature> and a complementarity c_<feature> for each feature) of all i < j, made by one kernel.

    people has a vector column for each feature and the profile columns named
    by `profiles`. Up to LOOKUP_SCORES scores (a counted table, 24 bytes each)
    go to the kernel; a larger table is joined instead.
    """
    features = list(profiles)
    if usable(scores).count() > LOOKUP_SCORES:
        wide = people.select(key, *[F.col(c).alias(f) for f, c in profiles.items()])
        return complementarities(similarities(people, features, key), wide, scores, features, key, default)
    return _pairs(coded(people, profiles, key), features, {f: f"_code_{f}" for f in features}, score_table(scores), default, key)


def usable(scores: DataFrame) -> DataFrame:
    return scores.where("coalesce(target, '') <> '' and coalesce(comparison, '') <> ''")


def score_table(scores: DataFrame) -> ScoreTable:
    """Scores (category, target, comparison, score) for the kernel's lookup."""
    rows = usable(scores).select("category", _code(F.col("category"), F.col("target")).alias("t"), _code(F.col("category"), F.col("comparison")).alias("c"), F.col("score").cast("double").alias("score"))
    return ScoreTable.of(rows.groupBy("category", "t", "c").agg(F.max("score").alias("score")).toPandas())


def coded(people: DataFrame, profiles: dict[str, str], key: str) -> DataFrame:
    """key, the features' vectors and _code_<feature>, the profile's code."""
    return people.select(key, *profiles, *[_code(F.lit(f), F.col(c)).alias(f"_code_{f}") for f, c in profiles.items()])


def near(people: DataFrame, vector: str, least: float, key: str = "person_id") -> DataFrame:
    """(i, j) of all i < j of a cosine of at least `least`: the kernel hands on those pairs alone.

    Cosines are made in single precision first, in double where they may reach
    the limit by a bound of the rounding.
    """

    def prepare(rows):
        x = unit_matrix(rows.column("v"))
        return rows.column("id").to_numpy(), x, x.astype(np.float32)

    def pair(left, right, keep):
        rounding = (left[1].shape[1] + 6) * 2.0**-23
        i, j = np.nonzero((left[2] @ right[2].T >= np.float32(least - rounding)) & keep)
        found = np.einsum("ij,ij->i", left[1][i], right[1][j]) >= least
        return pa.RecordBatch.from_arrays([pa.array(left[0][i[found]]), pa.array(right[0][j[found]])], ["i", "j"])

    strip, sides = _strip(people, key, [vector])
    rows = people.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), strip.alias("_at"))
    return grid.triangle(rows, F.col("_at"), sides, ["id"], prepare, pair, "i long, j long")


def threshold_sums(people: DataFrame, vector: str, above: float = 0.0, key: str = "person_id") -> DataFrame:
    """(pairs, n, total): how many of all pairs have a cosine above a limit, all pairs and their sum, summed in the kernel so that no pair becomes a row."""

    def pair(x, y, keep):
        own = (x @ y.T)[keep]
        return pa.RecordBatch.from_arrays([pa.array([int((own > above).sum())]), pa.array([len(own)]), pa.array([float(own.sum())])], ["pairs", "n", "total"])

    strip, sides = _strip(people, key, [vector])
    rows = people.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), strip.alias("_at"))
    sums = grid.triangle(rows, F.col("_at"), sides, ["id"], lambda rows: unit_matrix(rows.column("v")), pair, "pairs long, n long, total double")
    return sums.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))


def minmax(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns scaled to [0, 1] over all pairs; a constant column becomes 0.5."""
    stats = pairs.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.lit(0.5)) for c in columns}
    return pairs.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def directed(scores: DataFrame) -> DataFrame:
    """(category, target, comparison, score) in both directions: a missing direction takes the score of the other."""
    turned = scores.select("category", F.col("comparison").alias("target"), F.col("target").alias("comparison"), F.col("score").alias("back"))
    both = scores.join(turned, ["category", "target", "comparison"], "full")
    return both.select("category", "target", "comparison", F.coalesce("score", "back").alias("score"))


def complementarities(pairs: DataFrame, wide: DataFrame, scores: DataFrame, features: Sequence[str], key: str = "person_id", default: float = 0.5) -> DataFrame:
    """pairs with c_<feature>: the score of (profile i, profile j), else of (j, i), else the default; empty profiles have the default."""
    left = wide.select(F.col(key).alias("i"), *[F.col(f).alias(f"_i_{f}") for f in features])
    right = wide.select(F.col(key).alias("j"), *[F.col(f).alias(f"_j_{f}") for f in features])
    out = pairs.join(left, "i").join(right, "j")
    both = directed(scores)
    for f in features:
        own = both.where(F.col("category") == f).select(F.col("target").alias(f"_i_{f}"), F.col("comparison").alias(f"_j_{f}"), F.col("score").alias(f"_c_{f}"))
        empty = (F.coalesce(F.col(f"_i_{f}"), F.lit("")) == "") | (F.coalesce(F.col(f"_j_{f}"), F.lit("")) == "")
        out = out.join(own, [f"_i_{f}", f"_j_{f}"], "left").withColumn(f"c_{f}", F.when(empty, F.lit(default)).otherwise(F.coalesce(F.col(f"_c_{f}"), F.lit(default))))
    return out.select(*pairs.columns, *[f"c_{f}" for f in features])


def cross_scores(profiles: DataFrame) -> DataFrame:
    """All ordered profile pairs within a feature: (category, target, comparison)."""
    a = profiles.select(F.col("feature").alias("category"), F.col("profile").alias("target"))
    b = profiles.select(F.col("feature").alias("category"), F.col("profile").alias("comparison"))
    return a.join(b, "category")


def edges(scored: DataFrame, features: Sequence[str], w_s: dict[str, float] | None = None, w_c: dict[str, float] | None = None, settings: Settings = Settings()) -> DataFrame:
    """(src, dst, weight) from pairs with normalised similarities <feature> and raw complementarities c_<feature>."""
    a, b = means({f: F.col(f) for f in features}, {f: F.col(f"c_{f}") for f in features}, w_s or SIMILARITY_WEIGHTS, w_c or COMPLEMENTARITY_WEIGHTS, settings)
    return scored.select("i", "j", a.alias("_a"), b.alias("_b")).select(F.col("i").alias("src"), F.col("j").alias("dst"), blended(F.col("_a"), F.col("_b"), settings).alias("weight"))


#: Rows of one tag that a task meets on either side.
DEAL = 4096
#: The join of jaccard may meet one in so many of all pairs.
CROWDED = 32


def jaccard(tags: DataFrame, key: str, column: str, threshold: float = 0.0) -> DataFrame:
    """(i, j, jaccard) of the tag sets of all i < j that share a tag and reach the threshold; pairs that share none are 0 and left out.

    A set join with prefix filter: tags are ordered by frequency, the rarest
    first; sets of similarity t share one of the first n - ceil(t n) + 1 of
    their n tags, so only those are joined (all of them for threshold 0, where
    the shared tags are counted by the join itself). A frequent tag's rows are
    dealt over a grid of cells of DEAL rows, so none meets in one task. Where
    that join would meet more than one in CROWDED of all pairs (counted), all
    pairs are compared by a kernel, which shuffles sets and no pairs.
    """
    sets = written(tags.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_distinct(column).alias("s")).where(F.size("s") > 0), "sets")
    each = sets.select("id", F.explode("s").alias("tag"))
    counts = written(each.groupBy("tag").agg(F.count("*").alias("f")), "tags")
    total = each.count()
    if threshold <= 0:
        n, met = sets.count(), counts.agg(F.sum(F.col("f").cast("double") * (F.col("f") - 1) / 2)).first()[0] or 0.0
        if met * CROWDED > n * (n - 1) / 2:
            return _jaccard_cells(sets, n)
    rows = with_keyed(each, counts, ["tag"], "f", total)
    if threshold > 0:
        sized = sets.select("id", F.size("s").alias("n"))
        place = F.row_number().over(Window.partitionBy("id").orderBy("f", "tag"))
        rows = rows.join(sized, "id").withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("id", "tag", "f")
    rows = written(rows.withColumn("g", F.ceil(F.col("f") / DEAL).cast("int")), "dealt")
    strip, sides = F.pmod(F.xxhash64("id"), F.col("g")).cast("int"), F.sequence(F.lit(0), F.col("g") - 1)
    a = rows.select(F.col("id").alias("i"), "tag", strip.alias("a"), F.explode(sides).alias("b"))
    b = rows.select(F.col("id").alias("j"), "tag", F.explode(sides).alias("a"), strip.alias("b"))
    met = a.join(b, ["tag", "a", "b"]).where("i < j")
    one, other = (sets.select(F.col("id").alias(x), F.size("s").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in ("i", "j"))
    if threshold > 0:
        shared = met.select("i", "j").distinct().join(one, "i").join(other, "j").withColumn("k", F.size(F.array_intersect("si", "sj")))
    else:
        shared = met.groupBy("i", "j").agg(F.count("*").alias("k")).join(one.drop("si"), "i").join(other.drop("sj"), "j")
    found = shared.select("i", "j", (F.col("k") / (F.col("ni") + F.col("nj") - F.col("k"))).alias("jaccard"))
    return found.where(F.col("jaccard") >= threshold)


def _jaccard_cells(sets: DataFrame, n: int) -> DataFrame:
    """jaccard of all pairs of (id, s) that share a tag, on the grid."""
    sides = grid.strips(n, 8 * max(1, sets.agg(F.max(F.size("s"))).first()[0] or 1), grid.tasks_of(sets))
    own = sets.select("id", F.transform(F.filter("s", lambda t: t.isNotNull()), lambda t: F.xxhash64(t)).alias("tags"), F.size("s").alias("n"))

    def prepare(rows):
        tags, sizes = rows.column("tags"), np.asarray(rows.column("tags").value_lengths()).astype(np.int64)
        names, place = np.unique(tags.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        has = np.zeros((len(sizes), len(names)), np.float32)
        has[np.repeat(np.arange(len(sizes)), sizes), place] = 1
        return rows.column("id"), rows.column("n").to_numpy(), names, has

    def pair(left, right, keep):
        _, a, b = np.intersect1d(left[2], right[2], assume_unique=True, return_indices=True)
        both = left[3][:, a] @ right[3][:, b].T
        i, j = np.nonzero((both > 0) & keep)
        k = both[i, j].astype(np.float64)
        x, y = left[0].take(pa.array(i)), right[0].take(pa.array(j))
        turned, same = pc.greater(x, y), pc.equal(x, y)
        out = pa.RecordBatch.from_arrays([pc.if_else(turned, y, x), pc.if_else(turned, x, y), pa.array(k / (left[1][i] + right[1][j] - k))], ["i", "j", "jaccard"])
        return out.filter(pc.invert(same)) if pc.any(same).as_py() else out

    kind = sets.schema["id"].dataType.simpleString()
    return grid.triangle(own, F.pmod(F.xxhash64("id"), F.lit(sides)), sides, ["id", "tags"], prepare, pair, f"i {kind}, j {kind}, jaccard double")


def jaccard_sum(sets: DataFrame, column: str, count: str) -> DataFrame:
    """(total): the sum over all pairs of different rows of the Jaccard similarity of their tag sets, times both rows' counts.

    Tiles of rows are compared by a kernel that hands on one sum, so a tag
    that everyone has costs no more than any other.
    """
    n, widest = sets.agg(F.count("*"), F.max(F.size(column))).first()
    sides = grid.strips(n, 8 * max(1, widest or 1), grid.tasks_of(sets)) if n else 1
    own = sets.select(F.transform(F.array_distinct(column), lambda t: F.xxhash64(t)).alias("tags"), F.col(count).cast("double").alias("k"))
    own = own.withColumn("at", F.xxhash64("tags", "k"))

    def prepare(rows):
        tags = rows.column("tags")
        return tags, np.asarray(tags.value_lengths()).astype(np.int64), rows.column("k").to_numpy()

    def pair(left, right, keep):
        names, place = np.unique(np.concatenate([t[0].flatten().to_numpy(zero_copy_only=False) for t in (left, right)]), return_inverse=True)
        x, y = (np.zeros((len(side[0]), len(names)), np.float32) for side in (left, right))
        x[np.repeat(np.arange(len(x)), left[1]), place[: left[1].sum()]] = 1
        y[np.repeat(np.arange(len(y)), right[1]), place[left[1].sum() :]] = 1
        both = (x @ y.T).astype(np.float64)
        either = left[1][:, None] + right[1][None, :] - both
        near = np.divide(both, either, out=np.zeros_like(both), where=either > 0) * np.outer(left[2], right[2])
        return pa.RecordBatch.from_arrays([pa.array([float(near[keep].sum())])], ["total"])

    sums = grid.triangle(own, F.pmod("at", F.lit(sides)), sides, ["at", "tags", "k"], prepare, pair, "total double")
    return sums.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
