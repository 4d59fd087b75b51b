"""Language-model scoring with a Brown class-based bigram model.

P(word | previous) = P(class | class of previous) * P(word | class). Words are
the maximal runs of non-space bytes, lower-cased (A-Z), and each text closes
with one end token, which also stands before its first word.

Counts cover all training texts: word counts are summed by word (and grow with
the corpus, as a table, never on one machine). Classes are assigned in two
steps. Exchange clustering moves the HEAD most frequent words, the end token
and TAILS groups of all other words (by their last three bytes) between
classes while the class-bigram likelihood grows, on bigram counts of all
training texts. Then every other word of the BROADCAST_WORDS most frequent ones
goes to the class under which its own neighbours in all training texts are
likeliest; the counts of neighbours are a distributed table. Only still rarer
words keep their group's class. Class bigrams are then counted anew.

Smoothing: transitions interpolate class bigrams with class unigrams by
(n(c, d) + KAPPA * P(d)) / (n(c) + KAPPA); emissions are (c + 0.1) /
(N_class + 0.1 * (V_class + 1)), so an unseen word has a share of its group's class.

Scoring reads the texts once: the BROADCAST_WORDS most frequent words (a fixed
size; of words as frequent as the last ones taken those with small hashes) are
looked up where the text is, only rarer words are joined with the word table.
Words are identified by 64-bit hashes.

Defined results: a null text is empty and scores its end token alone; rows
that repeat are scored each; without training texts all counts are 0. Only the
named columns are read, so others may have any name. A very long text is
scored alone, with about 60 bytes of memory a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import flat
from kinloom.llm.common import map_batches, written

HEAD, TAILS, CLASSES, SWEEPS = 640, 128, 32, 6
UNITS = HEAD + TAILS + 1
END_UNIT = HEAD + TAILS  # of the exchange clustering
BROADCAST_WORDS = 1 << 18
#: Distinct words that a task sums up before it hands them on.
HELD_WORDS = 800_000
DELTA, KAPPA = 0.1, 5.0
#: The end token's place among word hashes.
END_HASH = np.uint64(0x5EED0E4D)
_TAIL = flat.seeds(3, 41) | np.uint64(1)


def tokens(t: flat.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the group of each by its last three bytes, and the bounds of each text's words."""
    words = flat.Words(t)
    hashes = flat.span_hash(t.data, words.starts, words.ends)
    tail = np.zeros(len(hashes), np.uint64)
    for j in range(3):
        at = words.ends - 1 - j
        tail += np.where(at >= words.starts, flat.LOWER[t.data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0)) * _TAIL[j]
    return hashes, (flat.mix(tail) >> np.uint64(32)).astype(np.int64) % TAILS, words.at


class Lookup:
    """Positions of hashes in a fixed set, by open addressing."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.bits = max(4, int(len(hashes) * 4 - 1).bit_length()) if len(hashes) else 4
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.mask = (1 << self.bits) - 1
        todo, slot = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.place[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]] = hashes[todo[won]]
            self.place[slot[won]] = todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 where it isn't in the set."""
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.place[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.place[slot] >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            hit = (self.keys[slot] == hashes[todo]) & (self.place[slot] >= 0)
            out[todo[hit]] = self.place[slot[hit]]
            more = ~hit & (self.place[slot] >= 0)
            todo, slot = todo[more], slot[more]
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, tail, c): how often each word stands in the column `text`."""

    def run(batches):
        held: list[tuple] = []

        def merged(parts):
            h = np.concatenate([x[0] for x in parts])
            one, first, which = np.unique(h, return_index=True, return_inverse=True)
            return one, np.concatenate([x[1] for x in parts])[first], np.bincount(which, weights=np.concatenate([x[2] for x in parts]), minlength=len(one)).astype(np.int64)

        def out(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["hash", "tail", "c"])

        size = 0
        for batch in batches:
            for t in flat.texts(batch.column(0), 2 << 20):
                hashes, tail, _ = tokens(t)
                if len(hashes):
                    held.append(merged([(hashes, tail, np.ones(len(hashes)))]))
                    size += len(held[-1][0])
                if size > HELD_WORDS:
                    part = merged(held)
                    held, size = [part], len(part[0])
                    if size > HELD_WORDS * 3 // 4:
                        yield out(part)
                        held, size = [], 0
        if held:
            yield out(merged(held))

    return texts.select("text").mapInArrow(run, "hash long, tail int, c long").groupBy("hash").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def frequent(vocabulary: DataFrame, most: int | None = None):
    """The rows of the most frequent words, by count, at most BROADCAST_WORDS.

    Histograms give them without a sort: all words above a log count, and of
    those at it the ones with the smallest hashes.
    """
    step, place = F.floor(F.log2("c") * 16), F.shiftrightunsigned("hash", 52)

    def fitting(rows: DataFrame, by, left: int, falling: bool) -> tuple[int | None, int | None, int]:
        """The last bin taken whole, the first that isn't, and what is left."""
        last = None
        for r in sorted(rows.groupBy(by.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["k"] if falling else r["k"]):
            if r["n"] > left:
                return last, r["k"], left
            last, left = r["k"], left - r["n"]
        return last, None, left

    last, edge, left = fitting(vocabulary, step, most or BROADCAST_WORDS, True)
    take = step >= last if last is not None else F.lit(False)
    if edge is not None:
        upto, _, _ = fitting(vocabulary.where(step == edge), place, left, False)
        if upto is not None:
            take = take | (step == edge) & (place <= upto)
    found = vocabulary.where(take).toPandas()
    return found.sort_values(["c", "hash"], ascending=[False, True], ignore_index=True)


def pair_counts(texts: DataFrame, known: Lookup, class_of: np.ndarray, kinds: int) -> np.ndarray:
    """(kinds, kinds) counts of neighbouring units by class_of of their units; the last kind is the end token's."""
    shared = texts.sparkSession.sparkContext.broadcast((known, class_of))

    def run(batches):
        words, of = shared.value
        counts = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            for t in flat.texts(batch.column(0)):
                own = of[unit_sequence(words, t)[0]].astype(np.int64)
                counts += np.bincount(own[:-1] * kinds + own[1:], minlength=kinds * kinds)
                counts[(kinds - 1) * kinds + own[0]] += 1
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts[hit])], ["pair", "n"])

    out = np.zeros(kinds * kinds)
    found = texts.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out[found["pair"]] = found["n"]
    return out.reshape(kinds, kinds)


def unit_sequence(known: Lookup, t: flat.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts in a row, each closed by the end unit, and the position of each end.

    Units are the known words' places, then the groups of other words, then the end.
    """
    hashes, tail, at = tokens(t)
    place = known(hashes)
    ends = at[1:] + np.arange(len(t))
    out = np.full(len(hashes) + len(t), known.n + TAILS, np.int64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(t)), np.diff(at))] = np.where(place >= 0, place, known.n + tail)
    return out, ends


def assigned(texts: DataFrame, known: Lookup, class_of: np.ndarray, first: int, log_move: np.ndarray, log_total: np.ndarray) -> np.ndarray:
    """class_of with each known word from number `first` on in the class that makes its neighbours in all texts likeliest.

    The likelihood of a word in class k: its neighbours' transitions to and
    from k, and one share of k's size for each occurrence; equal ones go to
    the lower class. The end token's class takes no word.
    """
    shared = texts.sparkSession.sparkContext.broadcast((known, class_of))
    kinds = CLASSES

    def run(batches):
        words, of = shared.value
        held, size = [], 0

        def out():
            keys, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((keys // (2 * kinds)).astype(np.int32)), pa.array((keys % (2 * kinds)).astype(np.int16)), pa.array(n)], ["word", "slot", "n"])

        for batch in batches:
            for t in flat.texts(batch.column(0), 2 << 20):
                units, ends = unit_sequence(words, t)
                own, at = of[units].astype(np.int64), np.flatnonzero((units >= first) & (units < words.n))
                before = np.concatenate((own[-1:], own))[at]  # a text's first word has the end token before it
                keys, n = np.unique(np.concatenate((units[at] * (2 * kinds) + before, units[at] * (2 * kinds) + kinds + own[at + 1])), return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > 2 * HELD_WORDS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def best(batches):
        place, sums = np.full(known_n, -1, np.int64), np.zeros((1024, 2 * kinds))
        met = 0
        for batch in batches:
            word = batch.column(0).to_numpy()
            new = np.unique(word[place[word] < 0])
            place[new] = met + np.arange(len(new))
            met += len(new)
            while met > len(sums):
                sums = np.concatenate((sums, np.zeros_like(sums)))
            np.add.at(sums, (place[word], batch.column(1).to_numpy()), batch.column(2).to_numpy())
        mine = np.flatnonzero(place >= 0)
        own = sums[place[mine]]
        gain = own[:, :kinds] @ log_move + own[:, kinds:] @ log_move.T - own[:, kinds:].sum(axis=1, keepdims=True) * log_total
        yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array(gain[:, :-1].argmax(axis=1).astype(np.int32))], ["word", "class"])

    known_n = known.n
    found = texts.select("text").mapInArrow(run, "word int, slot short, n long").repartition("word").mapInArrow(best, "word int, class int").toPandas()
    out = class_of.copy()
    out[found["word"].to_numpy()] = found["class"].to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit: each in turn moves to the class that raises the class-bigram likelihood most; the last class is the end unit's own.

    Equal gains go to the lower class; a sweep without a move ends the search.
    """
    n = len(counts)
    weight = counts.sum(axis=1) + counts.sum(axis=0)
    order = [u for u in np.argsort(-weight, kind="stable") if u != n - 1 and weight[u]]
    of = np.zeros(n, np.int64)
    free = classes - 1
    of[order] = np.arange(len(order)) % free
    of[n - 1] = free
    member = np.eye(classes)[of]
    grid = member.T @ counts @ member
    for _ in range(sweeps):
        moved = 0
        for u in order:
            was = of[u]
            right, left, own = counts[u] @ member, counts[:, u] @ member, counts[u, u]
            # Take u out: right and left still count u itself in its class.
            right[was] -= own
            left[was] -= own
            grid[was] -= right
            grid[:, was] -= left
            grid[was, was] -= own
            # Likelihood terms of the rows, columns and sums that change when u joins class k.
            rows, cols = grid.sum(axis=1), grid.sum(axis=0)
            r, l = right.sum() + own, left.sum() + own
            base = _xlogx(grid)
            gain = (_xlogx(grid[:free] + right) - base[:free]).sum(axis=1) + (_xlogx(grid[:, :free] + left[:, None]) - base[:, :free]).sum(axis=0)
            k = np.arange(free)
            corner = grid[k, k]
            gain += _xlogx(corner + right[k] + left[k] + own) - _xlogx(corner + right[k]) - _xlogx(corner + left[k]) + _xlogx(corner)
            gain -= _xlogx(rows[:free] + r) - _xlogx(rows[:free]) + _xlogx(cols[:free] + l) - _xlogx(cols[:free])
            to = int(gain.argmax())
            grid[to] += right
            grid[:, to] += left
            grid[to, to] += own
            if to != was:
                of[u] = to
                member[u, was], member[u, to] = 0, 1
                moved += 1
        if not moved:
            break
    return of


@dataclass
class Model:
    frequent: Lookup
    class_of: np.ndarray  # unit (frequent words, groups of others, the end) -> class
    log_move: np.ndarray  # (class, class) log10
    log_size: np.ndarray  # class -> log10(N_class + DELTA * (V_class + 1))
    frequent_log: np.ndarray  # log10(c + DELTA)
    end_log: float
    total: int  # N
    distinct: int  # V


def _moves(grid: np.ndarray) -> np.ndarray:
    """Smoothed transition probabilities of class-bigram counts."""
    follow = grid.sum(axis=0)
    unigram = (follow + 0.5) / (follow.sum() + 0.5 * len(grid))
    return (grid + KAPPA * unigram) / (grid.sum(axis=1, keepdims=True) + KAPPA)


def fit(spark: SparkSession, texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table (hash, tail, c) of all training words."""
    vocabulary = written(spark, word_counts(texts), "words")
    n_texts = texts.count()
    top = frequent(vocabulary)
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    head, known = Lookup(hashes[:HEAD]), Lookup(hashes)
    # Exchange clustering; units of a head of fewer words stand where those of HEAD words would.
    places = np.concatenate((np.arange(head.n), HEAD + np.arange(TAILS + 1)))
    of = exchange(pair_counts(texts, head, places, UNITS), CLASSES)
    groups_of = of[HEAD:]
    class_of = np.concatenate((of[: head.n], groups_of[top["tail"].to_numpy(np.int64)[head.n :]], groups_of)).astype(np.int16)
    if known.n > head.n:
        grid = pair_counts(texts, known, class_of, CLASSES)
        class_of = assigned(texts, known, class_of, head.n, np.log(_moves(grid)), np.log(np.maximum(grid.sum(axis=0), 1.0)))
    move = _moves(pair_counts(texts, known, class_of, CLASSES))
    # Class sizes over all words: frequent words one by one, the others by group.
    groups = {r["tail"]: (r["n"], r["v"]) for r in vocabulary.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    own = np.zeros((TAILS, 2))
    for g, x in groups.items():
        own[g] = x
    each = np.stack([top["c"].to_numpy(float), np.ones(known.n)], axis=1)
    np.subtract.at(own, top["tail"].to_numpy(np.int64), each)
    sizes = np.zeros((CLASSES, 2))
    np.add.at(sizes, class_of[: known.n], each)
    np.add.at(sizes, groups_of[:TAILS], own)
    sizes[groups_of[TAILS]] += (n_texts, 1)
    total = int(sum(x[0] for x in groups.values())) + n_texts
    distinct = int(sum(x[1] for x in groups.values())) + (n_texts > 0)
    unseen = np.ones(CLASSES)  # each class keeps the mass of one unseen word, but for the end token's
    unseen[groups_of[TAILS]] = 0
    log_size = np.log10(np.maximum(sizes[:, 0] + DELTA * (sizes[:, 1] + unseen), DELTA))
    return Model(known, class_of, np.log10(move), log_size, np.log10(top["c"].to_numpy(float) + DELTA), float(np.log10(n_texts + DELTA)), total, distinct), vocabulary


def scored(spark: SparkSession, docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of rows (doc_id, held_out, text)."""
    shared = spark.sparkContext.broadcast(model)

    def kernel():
        m = shared.value

        def each(batch):
            for t in flat.texts(batch.column(3)):
                hashes, tail, at = tokens(t)
                units, ends = unit_sequence(m.frequent, t)
                of = m.class_of[units].astype(np.int64)
                before = np.empty_like(of)
                before[1:] = of[:-1]
                before[np.concatenate(([0], ends[:-1] + 1))] = m.class_of[-1]
                inner = m.log_move[before, of] - m.log_size[of]
                starts = np.concatenate(([0], ends[:-1] + 1))
                inner = np.add.reduceat(inner, starts)
                place = m.frequent(hashes)
                known = np.concatenate(([0.0], np.cumsum(np.where(place >= 0, m.frequent_log[np.maximum(place, 0)], 0.0) if len(m.frequent_log) else np.zeros(len(hashes)))))
                emit = known[at[1:]] - known[at[:-1]] + m.end_log
                n_known = np.diff(np.concatenate(([0], np.cumsum(place >= 0)))[at]) + (m.total > 0)
                rare = np.flatnonzero(place < 0)
                row = np.searchsorted(at, rare, "right") - 1
                rare_at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(t)))))
                lists = pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(hashes[rare].view(np.int64)))
                own = batch.slice(t.first, len(t)).columns[:3]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at) + 1), pa.array(n_known), pa.array(emit), pa.array(inner), lists], ["doc_id", "held_out", "digest", "n_tokens", "n_known", "emit", "inner", "rare"])

        return each

    rows = docs.select("doc_id", "held_out", F.xxhash64("text").alias("digest"), F.col("text").alias("_text"))
    part = written(spark, map_batches(rows, kernel, "doc_id long, held_out boolean, digest long, n_tokens long, n_known long, emit double, inner double, rare array<long>"), "scores")
    # Rare words by document; a repeated row (same id and text) brings its words again, so sums are divided by its copies.
    rare = part.where(F.size("rare") > 0).select("doc_id", "digest", F.explode("rare").alias("hash"))
    counts = rare.groupBy("doc_id", "digest", "hash").agg(F.count("*").alias("tf"))
    known = counts.join(vocabulary.select("hash", "c"), "hash", "left")
    sums = known.groupBy("doc_id", "digest").agg(F.sum(F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(DELTA))).alias("far"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("far_known"), F.sum("tf").alias("far_all"))
    sums = sums.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "far", "far_known", "far_all")
    whole = part.withColumn("own", F.size("rare")).drop("rare").join(sums, part.doc_id.eqNullSafe(sums.i) & (part.digest == sums.d), "left")
    share = F.coalesce(F.col("own") / F.col("far_all"), F.lit(0.0))
    emit = F.col("emit") + F.coalesce(F.col("far") * share, F.lit(0.0))
    known = F.col("n_known") + F.coalesce(F.round(F.col("far_known") * share).cast("long"), F.lit(0))
    norm = float(np.log10(model.total + DELTA * (model.distinct + 1)))
    return whole.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (emit - F.col("n_tokens") * norm).alias("base_score"), (emit + F.col("inner")).alias("score"))
