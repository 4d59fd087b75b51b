"""Statistics of the matrices, their labels and texts; TF-IDF similarity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import grid
from kinloom.operators.pairs import cross_scores
from kinloom.scratch import written

# Lower bounds of the labels.
DIVERSITY = ((0.8, "very_low"), (0.6, "low"), (0.4, "moderate"), (0.2, "high"))
POTENTIAL = ((0.7, "excellent"), (0.5, "good"), (0.3, "moderate"))


def _label(x: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    out = F.lit(rest)
    for least, name in reversed(cuts):
        out = F.when(x > least, name).otherwise(out)
    return out


def feature_stats(scored: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row for each feature: mean and population variance of both matrices over i < j, labels and homogeneity, in one pass."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"sm_{f}"), F.var_pop(f).alias(f"sv_{f}"), F.avg(f"c_{f}").alias(f"cm_{f}"), F.var_pop(f"c_{f}").alias(f"cv_{f}")]
    row = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"sm_{f}").alias("similarity_mean"), F.col(f"sv_{f}").alias("similarity_variance"), F.col(f"cm_{f}").alias("complementarity_mean"), F.col(f"cv_{f}").alias("complementarity_variance")) for f in features])).alias("x")
    return _labelled(scored.agg(*aggs).select(row).select("x.*"))


def stats_of_sums(sums: DataFrame) -> DataFrame:
    """As feature_stats, from the sums over all pairs (pair_graph.PairGraph.stats): scaling to [0, 1] moves a mean and divides a variance."""
    n, span = F.col("n"), F.col("high") - F.col("low")
    var = lambda s, ss: F.greatest(F.col(ss) / n - F.pow(F.col(s) / n, F.lit(2.0)), F.lit(0.0))
    mean = F.when(span > 0, (F.col("s") / n - F.col("low")) / span).otherwise(0.5)
    spread = F.when(span > 0, var("s", "ss") / (span * span)).otherwise(0.0)
    return _labelled(sums.select("feature", mean.alias("similarity_mean"), spread.alias("similarity_variance"), (F.col("c") / n).alias("complementarity_mean"), var("c", "cc").alias("complementarity_variance")))


def _labelled(out: DataFrame) -> DataFrame:
    return out.withColumns({"diversity_level": _label(F.col("similarity_mean"), DIVERSITY, "very_high"), "complementarity_potential": _label(F.col("complementarity_mean"), POTENTIAL, "limited"), "homogeneity_score": F.col("similarity_mean") * (1 - F.col("similarity_variance"))})


# Advice and the phrases of the context text.
ADVICE = ("reduce_both_weights", "emphasize_complementarity", "balanced_or_emphasize_complementarity", "emphasize_similarity", "balanced_weights")
HOMOGENEITY = ((0.7, "very homogeneous"), (0.5, "moderately homogeneous"), (0.3, "diverse"))
MATCHING = ((0.7, "excellent matching opportunities"), (0.5, "good matching potential"), (0.3, "limited matching opportunities"))
GUIDANCE = (" - lower both weights since diversity is already maximized", " - increase complementarity weights to add diversity")


def recommendation(stats: DataFrame) -> DataFrame:
    """Which weights of a feature to move, by its two labels."""
    alike, apart = F.col("diversity_level").isin("very_low", "low"), F.col("diversity_level").isin("high", "very_high")
    fits = F.col("complementarity_potential").isin("excellent", "good")
    advice = F.when(alike & ~fits, ADVICE[0]).when(alike, ADVICE[1]).when(apart & fits, ADVICE[2]).when(apart, ADVICE[3]).otherwise(ADVICE[4])
    return stats.select("feature", advice.alias("recommendation"))


def context(stats: DataFrame) -> DataFrame:
    """One text over all features, in order of name."""
    s, c = F.col("similarity_mean"), F.col("complementarity_mean")
    hint = F.when((s < 0.3) & (c > 0.7), GUIDANCE[0]).when((s > 0.7) & (c < 0.3), GUIDANCE[1]).otherwise("")
    phrase = F.concat("feature", F.lit(": "), _label(s, HOMOGENEITY, "extremely diverse"), F.lit(", "), _label(c, MATCHING, "very limited matching opportunities"), hint)
    texts = stats.select("feature", phrase.alias("p")).agg(F.array_sort(F.collect_list(F.struct("feature", "p"))).alias("all"))
    return texts.select(F.concat(F.lit("Dataset characteristics: "), F.array_join(F.col("all.p"), "; ")).alias("context"))


def tfidf(docs: DataFrame, key: str, text: str, terms: int = 100, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, term, weight): the `terms` most frequent terms of two or more word characters, idf = ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~x.isin(*stop_words) if stop_words else F.lit(True))
    tf = written(docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "terms")
    top = tf.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "term").limit(terms)
    n = docs.agg(F.count("*").alias("docs"))
    idf = top.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    size = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weighted.join(size, key).select(key, "term", (F.col("w") / F.col("size")).alias("weight"))


def dense_rows(weights: DataFrame, every: DataFrame, key: str, terms: int = 100) -> DataFrame:
    """TF-IDF rows as vectors over the (bounded) term list, zeros for documents without one."""
    place = weights.select("term").distinct().orderBy("term").limit(terms)
    names = F.broadcast(place.agg(F.array_sort(F.collect_list("term")).alias("names")))
    rows = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m"))
    own = every.select(key).join(rows, key, "left").crossJoin(names)
    return own.select(key, F.transform("names", lambda t: F.coalesce(F.try_element_at(F.col("m"), t), F.lit(0.0))).alias("vector"))


#: Terms of one word of a document's mask.
MASK_BITS = 62


def pair_sums(weights: DataFrame, key: str, terms: int = 100) -> DataFrame:
    """(pairs, total) of TF-IDF rows (key, term, weight > 0): how many pairs of documents share a term, and the sum of the inner products of all pairs.

    The sum follows from the terms' sums. Pairs are counted by the documents'
    distinct sets of terms, as masks: those that share none are counted on the
    grid, where tiles of like masks are mostly decided by what all or any of
    their rows have.
    """
    squares = weights.where(F.col(key).isNotNull()).groupBy("term").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("ss"), F.count("*").alias("n"))
    squares = written(squares, "sums")
    total = squares.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("ss")) / 2).alias("total"))
    words = -(-terms // MASK_BITS)
    # the most frequent terms stand first, so that sorted masks agree in them
    place = F.broadcast(squares.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).alias("at")))  # a row for each of the terms
    bit = F.expr(f"shiftleft(1L, cast({MASK_BITS - 1} - at % {MASK_BITS} AS int))")
    names = [f"m{k}" for k in range(words)]
    masks = weights.where(F.col(key).isNotNull()).join(place, "term").groupBy(key).agg(*[F.bit_or(F.when(F.floor(F.col("at") / MASK_BITS) == k, bit).otherwise(F.lit(0).cast("long"))).alias(n) for k, n in enumerate(names)])
    masks = written(masks.groupBy(*names).agg(F.count("*").alias("k")), "masks")
    sides = grid.strips(masks.count(), 8 * (words + 1), grid.tasks_of(masks))
    apart = grid.triangle_cells(masks, F.pmod(F.xxhash64(*names), F.lit(sides)), sides, names, lambda n: _Apart(n, names), "apart long").agg(F.coalesce(F.sum("apart"), F.lit(0)).alias("apart"))
    docs = masks.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("d"))
    shared = (F.col("d") * (F.col("d") - 1) / 2).cast("long") - F.col("apart")
    return docs.crossJoin(apart).crossJoin(total).select(shared.alias("pairs"), "total")


class _Apart(grid.Cell):
    """How many pairs of documents have masks without a common bit; rows are distinct masks, k documents each."""

    def __init__(self, number: int, names: list[str]):
        super().__init__(number)
        b = (math.isqrt(8 * number + 1) - 1) // 2
        self.diagonal = number == b * (b + 1) // 2 + b
        self.names, self.held, self.joined, self.apart = names, [], None, 0

    def tile(self, rows):
        m = np.stack([rows.column(n).to_numpy() for n in self.names])
        return m, rows.column("k").to_numpy()

    def left(self, rows):
        self.held.append(self.tile(rows))

    def right(self, rows):
        if self.joined is None:
            self.joined = [np.stack(x, axis=1) for x in ([np.bitwise_and.reduce(m, axis=1) for m, _ in self.held], [np.bitwise_or.reduce(m, axis=1) for m, _ in self.held])] + [np.array([k.sum() for _, k in self.held])] if self.held else []
        if self.held:
            m, k = self.tile(rows)
            every, some, sizes = self.joined
            meet = ((every & np.bitwise_and.reduce(m, axis=1)[:, None]) != 0).any(axis=0)
            never = ((some & np.bitwise_or.reduce(m, axis=1)[:, None]) == 0).all(axis=0)
            self.apart += int(sizes[never].sum()) * int(k.sum())
            for at in np.flatnonzero(~meet & ~never).tolist():
                x, n = self.held[at]
                free = (x[0][:, None] & m[0][None, :]) == 0
                for a, b in zip(x[1:], m[1:], strict=True):
                    free &= (a[:, None] & b[None, :]) == 0
                i, j = np.nonzero(free)
                self.apart += int((n[i] * k[j]).sum())
        return iter(())

    def end(self):
        # a strip that meets itself meets each pair twice, and no mask is apart from itself
        yield pa.RecordBatch.from_arrays([pa.array([self.apart // 2 if self.diagonal else self.apart], pa.int64())], ["apart"])


def live_scores(scores: DataFrame, profiles: DataFrame) -> DataFrame:
    """Scores (category, target, comparison, score) whose two profiles (feature, profile) still exist."""
    live = profiles.select(F.col("feature").alias("category"), F.col("profile").alias("target")).distinct()
    return scores.join(live, ["category", "target"], "left_semi").join(live.withColumnRenamed("target", "comparison"), ["category", "comparison"], "left_semi")


def filled_scores(scores: DataFrame, profiles: DataFrame, absent: float = 0.0) -> DataFrame:
    """All ordered profile pairs of a category (a dense matrix as rows) with their scores, `absent` where there is none, and min-max scaled over each category (0.5 where all are equal)."""
    every = cross_scores(profiles.distinct())
    full = every.join(scores, ["category", "target", "comparison"], "left").withColumn("score", F.coalesce("score", F.lit(absent)))
    span = full.groupBy("category").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.5))
    return full.join(F.broadcast(span), "category").select("category", "target", "comparison", "score", scaled.alias("scaled"))
