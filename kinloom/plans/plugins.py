"""Embedder, Scorer, Tuner and Selector, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import replies
from kinloom.functions.vectors import summed, unit
from kinloom.operators.insights import tfidf
from kinloom.operators.pairs import cross_scores
from kinloom.schema import COMPLEMENTARITY_WEIGHTS, FEATURES, SIMILARITY_WEIGHTS


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Tuner(Protocol):
    def tune(self, prompt: str, context: str) -> tuple[dict[str, float], dict[str, float]]: ...


class Scorer(Protocol):
    """Replies to a prompt for one category: how well each of the comparisons complements each of the targets."""

    def reply(self, category: str, targets: Sequence[str], comparisons: Sequence[str]) -> str: ...


class Selector(Protocol):
    """Picks the name that stands for a cluster of tags; anything else than one of them counts as no answer."""

    def select(self, tags: Sequence[str]) -> str: ...


class HashedWords:
    """A signed hashed bag of words of unit length."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for r, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[r, h % self.dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).tolist()


def safely(embedder: Embedder, texts: Sequence[str]) -> list[list[float] | None]:
    """Vectors of a batch; if it fails or has a wrong shape, of its texts one by one; None where that fails too (zeros, not to be cached)."""

    def good(v) -> bool:
        return len(v) == embedder.dimensions

    try:
        found = [list(map(float, v)) for v in embedder.embed(texts)] if texts else []
        if len(found) == len(texts) and all(map(good, found)):
            return found
    except Exception:  # noqa: BLE001  a plugged-in model may fail in any way
        pass
    if len(texts) == 1:
        return [None]
    return [safely(embedder, [t])[0] for t in texts]


def embedded(tags: DataFrame, embedder: Embedder, batch: int = 2048) -> DataFrame:
    """(tag, vec, ok) of the distinct tags; failed ones are zero and not ok."""

    def run(frames):
        for pdf in frames:
            for s in range(0, len(pdf), batch):
                part = pdf["tag"].iloc[s : s + batch].tolist()
                found = safely(embedder, part)
                yield pd.DataFrame({"tag": part, "vec": [v or [0.0] * embedder.dimensions for v in found], "ok": [v is not None for v in found]})

    return tags.select("tag").distinct().mapInPandas(run, "tag string, vec array<double>, ok boolean")


def feature_vectors(tags: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(person_id, feature, vec): tag vectors summed (repeats count) and scaled to length 1; a person without tags has zeros."""
    each = tags.select("person_id", "feature", F.explode("tags").alias("tag")).join(vectors.select("tag", "vec"), "tag")
    sums = summed(each, ["person_id", "feature"], "vec")
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return tags.select("person_id", "feature").join(sums, ["person_id", "feature"], "left").select("person_id", "feature", unit(F.coalesce("vec", zero)).alias("vec"))


def estimated_scores(profiles: DataFrame) -> DataFrame:
    """(category, target, comparison, score) of all profile pairs of a feature: 1 - TF-IDF cosine, 0 for a profile with itself."""
    rows = profiles.select("feature", "profile").distinct().withColumn("id", F.concat_ws("\x1f", "feature", "profile"))
    w = tfidf(rows, "id", "profile", 100)
    a = w.select(F.col("id").alias("a"), "term", F.col("weight").alias("x"))
    b = w.select(F.col("id").alias("b"), "term", F.col("weight").alias("y"))
    near = a.join(b, "term").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))
    pairs = cross_scores(profiles).withColumns({"a": F.concat_ws("\x1f", "category", "target"), "b": F.concat_ws("\x1f", "category", "comparison")})
    score = F.when(F.col("target") == F.col("comparison"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("cos", F.lit(0.0))))
    return pairs.join(near, ["a", "b"], "left").select("category", "target", "comparison", score.alias("score"))


def scored_by(scorer: Scorer, profiles: DataFrame, batch: int = 8, default: float = 0.5) -> DataFrame:
    """(category, target, comparison, score) of all ordered pairs of distinct profiles of a feature, 0 for a profile with itself.

    Targets are packed `batch` to a prompt, each with all comparisons of their
    category; a failing scorer or an unreadable reply gives the default.
    """
    rows = profiles.select(F.col("feature").alias("category"), "profile").where("coalesce(profile, '') <> ''").distinct()
    place = F.row_number().over(Window.partitionBy("category").orderBy("profile")) - 1
    groups = rows.withColumn("g", F.floor(place / batch)).groupBy("category", "g").agg(F.array_sort(F.collect_list("profile")).alias("targets"))
    names = rows.groupBy("category").agg(F.array_sort(F.collect_list("profile")).alias("comparisons"))

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                targets, comparisons = list(r.targets), list(r.comparisons)
                try:
                    reply = scorer.reply(r.category, targets, comparisons) or ""
                except Exception:  # noqa: BLE001  a plugged-in model may fail in any way
                    reply = ""
                found = {targets[0]: replies.single(reply, comparisons, default)} if len(targets) == 1 and not any(t in reply for t in targets) else replies.batch(reply, targets, comparisons, default)
                for t in targets:
                    yield pd.DataFrame({"category": r.category, "target": t, "comparison": comparisons, "score": [0.0 if c == t else found[t][c] for c in comparisons]})

    return groups.join(names, "category").select("category", "targets", "comparisons").mapInPandas(run, "category string, target string, comparison string, score double")


def selected(selector: Selector, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, umbrella): the selector's choice among each cluster's tags (at most 50 of the most frequent are shown to it), else the most frequent, shortest, first one."""
    counted = clusters.groupBy(*keys, "tag").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.length("tag"), "tag"))
    shown = counted.withColumn("place", place).where("place <= 50").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("all")).select(*keys, F.col("all.tag").alias("tags"))

    @F.pandas_udf("string")
    def choose(tags: pd.Series) -> pd.Series:
        out = []
        for own in tags:
            names = list(own)
            try:
                answer = selector.select(names) if len(names) > 1 else names[0]
            except Exception:  # noqa: BLE001
                answer = None
            out.append(answer if answer in names else names[0])
        return pd.Series(out)

    return shown.select(*keys, choose("tags").alias("umbrella"))


class KeywordTuner:
    """Default weights, moved by words for three intents: alike, apart, or seniority."""

    INTENTS = (("similar", "peer", "alike"), ("complement", "hire", "partner", "mentor", "diverse"))

    def tune(self, prompt: str, context: str = "") -> tuple[dict[str, float], dict[str, float]]:
        s, c = dict(SIMILARITY_WEIGHTS), dict(COMPLEMENTARITY_WEIGHTS)
        words = (prompt or "").lower()
        for table, intent in ((s, self.INTENTS[0]), (c, self.INTENTS[1])):
            if any(w in words for w in intent):
                table.update({f: min(2.0, v * 1.5) for f, v in table.items()})
        return s, c


def tuned(tuner: Tuner | None, prompt: str | None, context: str = "") -> tuple[dict[str, float], dict[str, float]]:
    """Weights for a prompt: the defaults if it is blank or the tuner fails; at most 2, missing features as by default."""
    defaults = (dict(SIMILARITY_WEIGHTS), dict(COMPLEMENTARITY_WEIGHTS))
    if not tuner or not (prompt or "").strip():
        return defaults
    try:
        found = tuner.tune(prompt, context)
        return tuple({f: min(2.0, max(0.0, float(own.get(f, d[f])))) for f in FEATURES} for own, d in zip(found, defaults, strict=True))
    except Exception:  # noqa: BLE001
        return defaults
