"""What a subgraph has in common and who stands for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import rich_tags, strip
from kinloom.functions.vectors import cosine, dot, summed, unit
from kinloom.operators.pairs import jaccard_sum


def _top(df: DataFrame, by: str, order: list, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= n)


def unpivoted(scored: DataFrame, features: Sequence[str], *keys: str) -> DataFrame:
    """(keys, feature, sim, comp) from pairs with columns <feature> and c_<feature>."""
    return scored.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("sim"), F.col(f"c_{f}").alias("comp")) for f in features])).alias("x")).select(*keys, "x.*")


def centroids(vectors: DataFrame) -> DataFrame:
    """(feature, vec): the elementwise mean."""
    return summed(vectors, ["feature"], "vec", "avg")


def closest(vectors: DataFrame, key: str = "person_id", n: int = 5) -> DataFrame:
    """(feature, rank, key, cosine) of the n rows closest to their feature's centroid; zero rows and zero centroids are left out."""
    c = centroids(vectors).withColumnRenamed("vec", "_c")
    zero = lambda v: F.forall(v, lambda x: x == 0)
    scored = vectors.join(F.broadcast(c), "feature").where(~zero(F.col("vec")) & ~zero(F.col("_c"))).select("feature", key, cosine(F.col("vec"), F.col("_c")).alias("cosine"))
    return _top(scored, "feature", [F.desc("cosine"), key], n).select("feature", "rank", key, "cosine")


def complementarity_patterns(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    return patterns_of_means(long.groupBy("feature").agg(F.avg("comp").alias("average"), F.max("comp").alias("highest"), F.min("comp").alias("lowest"), F.count("*").alias("pairs")), weights)


def patterns_of_means(out: DataFrame, weights: dict[str, float]) -> DataFrame:
    """complementarity_patterns from (feature, average, highest, lowest, pairs)."""
    w = F.create_map(*[x for f, v in weights.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    return out.select("feature", "average", "highest", "lowest", w.alias("weight"), (w * F.col("average")).alias("weighted_average"), "pairs")


def top_pairs(long: DataFrame, n: int = 5) -> DataFrame:
    return _top(long, "feature", [F.desc("comp"), "i", "j"], n).select("feature", "rank", "i", "j", "comp")


def hybrid_patterns(long: DataFrame, w_s: dict[str, float], w_c: dict[str, float]) -> DataFrame:
    """Mean blended score of each feature and the balance of its two weighted means."""
    return hybrid_of_means(long.groupBy("feature").agg(F.avg("sim").alias("sim_mean"), F.avg("comp").alias("comp_mean")), w_s, w_c)


def hybrid_of_means(m: DataFrame, w_s: dict[str, float], w_c: dict[str, float]) -> DataFrame:
    """hybrid_patterns from (feature, sim_mean, comp_mean)."""
    pick = lambda w: F.create_map(*[x for f, v in w.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    a, b = pick(w_s), pick(w_c)
    ratio = (a * F.col("sim_mean")) / F.greatest(b * F.col("comp_mean"), F.lit(0.01))
    return m.select("feature", "sim_mean", "comp_mean", ((a * F.col("sim_mean") + b * F.col("comp_mean")) / (a + b)).alias("hybrid_mean"), ratio.alias("balance_ratio"), F.abs(1 - ratio).alias("imbalance"))


def feature_importance(long: DataFrame, w_s: dict[str, float], w_c: dict[str, float], proxy: bool = True) -> DataFrame:
    """Contribution of each feature to the edges (i, j, weight, feature, sim, comp): (ws sim + wc comp) / (ws + wc) * weight, summed, as a share of the edges' weight, ranked.

    proxy takes 1 - comp + 0.1 for the similarity, as the reported figures do.
    The weights alone decide which side dominates a feature; equal ones count for complementarity.
    """
    pick = lambda w: F.create_map(*[x for f, v in w.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    a, b = pick(w_s), pick(w_c)
    sim = (1 - F.col("comp") + 0.1) if proxy else F.col("sim")
    part = (a * sim + b * F.col("comp")) / (a + b)
    sums = long.groupBy("feature").agg(F.sum(part * F.col("weight")).alias("contribution"), F.sum("weight").alias("total"), F.avg(sim).alias("average_similarity"), F.avg("comp").alias("average_complementarity"), F.count("*").alias("edges"))
    return importance_of_sums(sums, w_s, w_c)


def importance_of_sums(sums: DataFrame, w_s: dict[str, float], w_c: dict[str, float]) -> DataFrame:
    """feature_importance from (feature, contribution, total, average_similarity, average_complementarity, edges)."""
    pick = lambda w: F.create_map(*[x for f, v in w.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    a, b = pick(w_s), pick(w_c)
    dominant = F.when(a > b, "similarity").otherwise("complementarity")
    own = lambda w: w / F.greatest(a + b, F.lit(0.001))
    ratio = F.greatest(own(a), own(b)) / F.greatest(F.least(own(a), own(b)), F.lit(0.001))
    place = F.row_number().over(Window.orderBy(F.desc("contribution"), "feature"))  # a row for each feature: six
    percentage = F.col("contribution") / F.greatest(F.col("total"), F.lit(0.001)) * 100
    return sums.select("feature", "contribution", percentage.alias("percentage"), "average_similarity", "average_complementarity", "edges", dominant.alias("dominant"), ratio.alias("dominance_ratio"), place.alias("rank"))


def dominance_split(importance: DataFrame) -> DataFrame:
    """How many features each side dominates, which mechanism that makes the primary one, and how one-sided it is (0 to 1)."""
    side = lambda name: F.count_if(F.col("dominant") == name)
    n = importance.agg(F.min_by("feature", "rank").alias("top_contributor"), side("similarity").alias("n_similarity"), side("complementarity").alias("n_complementarity"))
    mechanism = F.when(F.col("n_similarity") > F.col("n_complementarity"), "similarity").otherwise("complementarity")
    apart = F.abs(F.col("n_similarity") - F.col("n_complementarity")) / F.greatest(F.col("n_similarity") + F.col("n_complementarity"), F.lit(1))
    return n.select("*", mechanism.alias("primary_mechanism"), apart.alias("balance_score"))


def keywords(tags: DataFrame, people: int, share: float = 0.5, n: int = 20) -> DataFrame:
    """(tag, people): tags of at least max(1, share) of the people, the n most common."""
    each = tags.groupBy("tag").agg(F.countDistinct("person_id").alias("people"))
    return each.where(F.col("people") >= max(1.0, share * people)).orderBy(F.desc("people"), "tag").limit(n)


def shared_values(tags: DataFrame, n: int = 5) -> DataFrame:
    """(feature, rank, tag, mentions, percentage) of tags mentioned more than once, among the n most mentioned of a feature."""
    each = tags.groupBy("feature", "tag").agg(F.count("*").alias("mentions"))
    people = tags.agg(F.countDistinct("person_id").alias("people"))
    best = _top(each, "feature", [F.desc("mentions"), "tag"], n).where("mentions > 1")
    return best.crossJoin(F.broadcast(people)).select("feature", "rank", "tag", "mentions", (F.col("mentions") / F.col("people") * 100).alias("percentage"))


def diversity(tags: DataFrame, column: str = "tags") -> DataFrame:
    """Unique share of the tags, mean Jaccard distance over all i < j, and their product, of one table of tag lists."""
    sets = tags.select(F.array_sort(F.array_distinct(column)).alias("s")).groupBy("s").agg(F.count("*").alias("k"))
    n = tags.agg(F.count("*").alias("n"))
    flat = sets.select("k", F.explode("s").alias("t")).agg(F.sum("k").alias("total"), F.countDistinct("t").alias("unique"))
    # Equal sets are one row with a count; they are at distance 0 from each other (empty ones at 1).
    near = jaccard_sum(sets, "s", "k").withColumnRenamed("total", "apart")
    same = sets.where(F.size("s") > 0).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0.0)).alias("same"))
    both = n.crossJoin(F.broadcast(flat)).crossJoin(F.broadcast(near)).crossJoin(F.broadcast(same)).withColumn("s", F.col("apart") + F.col("same"))
    ratio = F.coalesce(F.try_divide(F.col("unique"), F.col("total")), F.lit(0.0))
    far = F.coalesce(1 - F.try_divide(F.col("s"), F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    return both.select(ratio.alias("unique_ratio"), far.alias("mean_distance"), (ratio * far).alias("diversity"))


def champions(vectors: DataFrame, weights: dict[str, float], key: str = "person_id", n: int = 1) -> DataFrame:
    """(feature, rank, key, score): the highest mean weighted cosine to all others.

    In closed form, (u . sum of u - u . u) / (n - 1) over unit vectors, so no pair is made.
    """
    own = vectors.select(key, "feature", unit(F.col("vec")).alias("u"))
    sums = summed(own, ["feature"], "u").withColumnRenamed("u", "_s").join(own.groupBy("feature").agg(F.count("*").alias("_n")), "feature")
    w = F.create_map(*[x for f, v in weights.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    score = w * F.coalesce(F.try_divide(dot(F.col("u"), F.col("_s")) - dot(F.col("u"), F.col("u")), F.col("_n") - 1), F.lit(0.0))
    scored = own.join(F.broadcast(sums), "feature").select("feature", key, score.alias("score"))
    return _top(scored, "feature", [F.desc(F.round("score", 12)), key], n).select("feature", "rank", key, "score")


def pair_champions(long: DataFrame, weights: dict[str, float], n: int = 1) -> DataFrame:
    """As champions, from complementarity scores of pairs (i, j, feature, comp), each counted for both ends."""
    ends = long.select("feature", "comp", F.explode(F.array("i", "j")).alias("person_id"))
    return champions_of_means(ends.groupBy("feature", "person_id").agg(F.avg("comp").alias("m")), weights, n)


def champions_of_means(means: DataFrame, weights: dict[str, float], n: int = 1) -> DataFrame:
    """pair_champions from (feature, person_id, m)."""
    w = F.create_map(*[x for f, v in weights.items() for x in (F.lit(f), F.lit(v))])[F.col("feature")]
    scored = means.select("feature", "person_id", (w * F.col("m")).alias("score"))
    return _top(scored, "feature", [F.desc(F.round("score", 12)), "person_id"], n).select("feature", "rank", "person_id", "score")


def selections(features: DataFrame) -> DataFrame:
    """Rows (feature, w_s, w_c) with the matrix to go by, the impact, the dominance and the priority."""
    dominance = F.greatest("w_s", "w_c") / F.greatest(F.least("w_s", "w_c"), F.lit(0.1))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("w_s") + F.col("w_c")), "feature"))  # six rows
    return features.select("feature", F.when(F.col("w_c") > F.col("w_s"), "complementarity").otherwise("similarity").alias("matrix"), (F.col("w_s") + F.col("w_c")).alias("impact"), dominance.alias("dominance"), place.alias("priority"))


def priorities(features: DataFrame) -> DataFrame:
    """Rows (feature, w_s, w_c) by impact, with the share of each weight (null where both are 0)."""
    share = lambda w: F.try_divide(F.col(w), F.col("w_s") + F.col("w_c"))
    shares = features.select("feature", share("w_s").alias("similarity_share"), share("w_c").alias("complementarity_share"))
    return selections(features).withColumnRenamed("matrix", "dominant").join(shares, "feature")


def candidate_rank(champs: DataFrame, features: DataFrame) -> DataFrame:
    """Champions by score * impact, 1.2 times that for complementarity."""
    own = champs.join(F.broadcast(selections(features)), "feature").withColumn("value", F.col("score") * F.col("impact") * F.when(F.col("matrix") == "complementarity", 1.2).otherwise(1.0))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("value", 12)), "feature", "person_id"))  # a row for each feature and champion
    return own.select("feature", "person_id", "value", place.alias("place"))


def member_profiles(wide: DataFrame, features: Sequence[str], key: str = "person_id") -> DataFrame:
    """(key, profiles): for each feature the raw value, its rich tags and its length."""
    cell = lambda f: F.struct(F.lit(f).alias("feature"), F.col(f).alias("raw"), rich_tags(F.col(f)).alias("tags"), F.length(F.coalesce(strip(F.col(f)), F.lit(""))).alias("length"))
    return wide.select(key, F.array(*map(cell, features)).alias("profiles"))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)
