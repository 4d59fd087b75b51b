"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are case-folded, everything else is a word boundary. Features are
letters (own buckets) and two- and three-character sequences with boundaries,
hashed. The log-probability matrix (languages x buckets, a fixed size for each
language) is broadcast; a text's score is its sparse count row times that
matrix, as a sum of gathered columns.

Defined results: a null text or one without a letter gives ('und', 0.0). Equal
posteriors go to the alphabetically first language. The score is the posterior
of the predicted language times the share of letters seen in training, so a
foreign script scores near 0. Repeated rows and ids are scored each; only the
text column is read, and kept columns may have any name. A very long text is
scored alone, with about 40 bytes of memory a character.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import flat
from kinloom.llm.common import filter_rows, map_batches, own_names, with_text

LETTER_BUCKETS = 1 << 12
GRAM_BUCKETS = 1 << 16
BUCKETS = LETTER_BUCKETS + GRAM_BUCKETS
#: Expected number of training texts for each language (a documented bound of the fit; all labelled texts where there are fewer).
SAMPLE_PER_LANGUAGE = 2000
#: Languages of one model; each takes a row of log-probabilities.
MOST_LANGUAGES = 1000
ALPHA = 0.1
#: N-grams whose log probabilities are gathered at once.
GATHERED = 1 << 21

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Letter -> its lower case, anything else -> space, for every code point of planes 0 to 3."""
    if not _fold:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x40000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold.append(out)
    return _fold[0]


def features(t: flat.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For letters, pairs and triples: bucket numbers, and the bounds of each text."""
    points, at = flat.codepoints(t)
    rows = len(t)
    seq = np.full(len(points) + rows + 1, 32, np.uint32)
    seq[np.arange(len(points)) + np.repeat(np.arange(1, rows + 1), np.diff(at))] = fold_table()[points]
    bounds = at + np.arange(1, rows + 2)  # text r: seq[bounds[r]:bounds[r+1]], its closing boundary included
    cur, one = seq[1:], seq[:-1]
    letter = cur != 32
    after = one != 32
    h = cur * np.uint32(0x9E3779B1)
    h1 = h + one * np.uint32(0x85EBCA6B)
    h2 = h1.copy()
    h2[1:] += seq[:-2] * np.uint32(0xC2B2AE35)
    out = []
    for where, hashed, shift, base in ((letter, h, 20, 0), (letter | after, h1 ^ (h1 >> 15), 16, LETTER_BUCKETS), (after, h2 ^ (h2 >> 13), 16, LETTER_BUCKETS)):
        take = np.flatnonzero(where)
        spread = hashed[take] * np.uint32(0x2C1B3C6D) if base else hashed[take]
        out.append(((spread >> np.uint32(shift)).astype(np.int32) + base, np.searchsorted(take, bounds - 1)))
    return out


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[..., at[r]:at[r+1]]."""
    out = np.zeros((*values.shape[:-1], len(at) - 1))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[..., full] = np.add.reduceat(values, at[:-1][full], axis=-1, dtype=np.float64)
    return out


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_prob: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, bool))

    def predict(self, t: flat.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The index of each text's language (-1: none) and the score."""
        found = features(t)
        letters = np.diff(found[0][1])
        if not self.languages:
            return np.full(len(t), -1), np.zeros(len(t))
        total = np.repeat(self.log_prior[:, None], len(t), axis=1)
        for idx, at in found:
            for s in range(0, len(idx), GATHERED):  # more than one step for a very long text only
                part = idx[s : s + GATHERED]
                total += _row_sums(np.take(self.log_prob, part, axis=1), np.clip(at - s, 0, len(part)))
        best = total.argmax(axis=0)
        top = total.max(axis=0)
        score = 1 / np.exp(total - top).sum(axis=0)
        score *= _row_sums(self.seen[found[0][0]].astype(np.float32), found[0][1]) / np.maximum(letters, 1)
        return np.where(letters > 0, best, -1), np.where(letters > 0, np.clip(score, 0, 1), 0.0)


def fit(spark: SparkSession, labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learns from rows (key, text, lang); a key's hash decides about the sample (the text's where the key is null), so a rerun takes the same rows. More than MOST_LANGUAGES languages are refused."""
    labelled = labelled.select("key", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: the model holds {BUCKETS * 4} bytes for each, on the driver and in every task; clean the label column")
    if not sizes:
        return Model([])
    languages = sorted(sizes)
    rates = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    own = F.when(F.col("key").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("key"))
    draw = F.pmod(own, F.lit(1 << 20)) / float(1 << 20)
    number = {k: i for i, k in enumerate(languages)}

    def kernel():
        def each(batch):
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            sums: dict[int, np.ndarray] = {}
            for t in flat.texts(batch.column(0)):
                own = langs[t.first : t.first + len(t)]
                for idx, at in features(t):
                    row_lang = np.repeat(own, np.diff(at))
                    for k in np.unique(row_lang).tolist():
                        sums[k] = sums.get(k, 0) + np.bincount(idx[row_lang == k], minlength=BUCKETS)
            for k, counts in sums.items():
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(hit.astype(np.int32)), pa.array(counts[hit])], ["lang", "bucket", "n"])

        return each

    sample = labelled.where(draw < rates[F.col("lang")]).select("text", "lang")
    counts = map_batches(sample, kernel, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), BUCKETS))
    table[counts["lang"], counts["bucket"]] = counts["n"]
    texts = np.array([sizes[k] for k in languages], float)
    return Model(languages, np.log(texts / texts.sum()), np.log((table + ALPHA) / (table.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)).astype(np.float32), table.sum(axis=0) > 0)


def predict(df: DataFrame, model: Model, keep: dict[str, str], text: str = "text") -> DataFrame:
    """Columns `keep` (name: type) of df with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = list(keep)
    mine = own_names(["lang_pred", "score"], names)
    rows, _ = with_text(df, names, text)

    def kernel():
        own = shared.value
        labels = np.array([*own.languages, "und"], object)

        def each(batch):
            found = [own.predict(t) for t in flat.texts(batch.column(len(names)))]
            best = np.concatenate([x[0] for x in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(labels[best], pa.string()), pa.array(np.concatenate([x[1] for x in found]))], [*names, *mine])

        return each

    return map_batches(rows, kernel, ", ".join([*(f"`{k}` {v}" for k, v in keep.items()), f"`{mine[0]}` string, `{mine[1]}` double"]))


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose language is identified with a score of at least `least`; columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        own = shared.value

        def keep(column):
            found = [own.predict(t) for t in flat.texts(column)]
            return np.concatenate([(x[0] >= 0) & (x[1] >= least) for x in found])

        return keep

    return filter_rows(df, text, kernel)
