"""Benchmark decontamination by SimHash of item-sized windows.

Items fall into classes by length; a class has a window length L (in words)
and a stride s with L + s - 1 <= the item's words, and each item is
fingerprinted at its first s offsets. Windows of a document start at multiples
of s, so a whole copy of an item always holds one window that stands exactly
on a fingerprinted part: only real edits cost bits. Fingerprints are 64-bit
SimHashes of word pairs, weighted by their occurrences, summed for all windows
by packed prefix sums.

Four 16-bit blocks index the fingerprints, each entered under every value
within two bits: of at most RADIUS = 11 differing bits one block holds at most
two, so every fingerprint within the radius is found. Candidates are then
verified exactly: the weighted Jaccard similarity of the bags of five-word
shingles of the item and of the item-sized window must reach 0.75.

A text that lacks an item's start or end has few windows that fit, or none.
So a text's first and last stretch are also looked up by exact shingles: a
window of similarity t shares at least t times the item's shingles, and every
item that has so many in a stretch of its length is verified there.

Defined results: null or empty texts and items hold nothing; an item or window
of one to four words is one shingle; an item found at several places reports
its best window, the first of equal ones; items and documents that repeat are
reported each. Other columns are not read, so they may have any name. A very
long text is scanned alone, with about 100 bytes of memory a byte.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import flat
from kinloom.llm.common import filter_rows, map_batches, written

RADIUS = 11
#: Words by which a verified window may stand beside the place that was found.
SHIFT = 2
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 2
#: Bytes of one index, on the driver and when broadcast; larger benchmarks are scanned in as many passes, one index at a time.
INDEX_BYTES = 64 << 20
_NEAR = np.array([0, *(sum(1 << b for b in c) for r in range(1, BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r))], np.uint64)
_PAIR = flat.seeds(2, 21) | np.uint64(1)


def features(hashes: np.ndarray, pairs: bool) -> np.ndarray:
    """What SimHash sums: hashes of word pairs (or of single words, for windows of up to three)."""
    return flat.mix(hashes[:-1] * _PAIR[0] + hashes[1:] * _PAIR[1]) if pairs else hashes


class BitSums:
    """Prefix sums of the 64 bit counts of a sequence of hashes, packed into 64-bit words of fields wide enough for `most` hashes."""

    def __init__(self, hashes: np.ndarray, most: int):
        self.width = next(w for w in (8, 16, 32) if most < (1 << (w - 1)))
        self.fields = 64 // self.width
        values = np.arange(1 << self.fields, dtype=np.uint64)
        spread = np.zeros(1 << self.fields, np.uint64)
        for f in range(self.fields):
            spread |= ((values >> np.uint64(f)) & np.uint64(1)) << np.uint64(f * self.width)
        self.lanes = []
        for lane in range(self.width):
            part = (hashes >> np.uint64(lane * self.fields)) & np.uint64((1 << self.fields) - 1)
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(spread[part.astype(np.uint8)], out=sums[1:])
            self.lanes.append(sums)

    def fingerprints(self, first: np.ndarray, n: int) -> np.ndarray:
        """SimHash of hashes [f, f + n) for each f: the bits that more than half of them have."""
        ones = sum(1 << (f * self.width) for f in range(self.fields))
        bias = np.uint64(ones * ((1 << (self.width - 1)) - 1 - n // 2))
        out = np.zeros(len(first), np.uint64)
        for lane, sums in enumerate(self.lanes):
            over = ((sums[first + n] - sums[first] + bias) >> np.uint64(self.width - 1)) & np.uint64(ones)
            if self.width == 8:
                packed = (over * np.uint64(0x0102040810204080)) >> np.uint64(56)
            else:
                packed = reduce(np.bitwise_or, (((over >> np.uint64(f * self.width)) & np.uint64(1)) << np.uint64(f) for f in range(self.fields)))
            out |= packed << np.uint64(lane * self.fields)
        return out


def size_class(words: int) -> tuple[int, int]:
    """(window length, stride) for items of so many words: the largest with length + stride - 1 <= words."""
    best, length = (1, 1), 1
    while length <= words:
        stride = max(1, length // 6)
        if length + stride - 1 <= words:
            best = (length, stride)
        length = max(length + 1, length * 5 // 4)
    return best


@dataclass
class SizeClass:
    length: int
    stride: int
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    blocks: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def enter(self) -> None:
        for b in range(BLOCKS):
            own = (self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
            keys = (own[:, None] ^ _NEAR[None, :]).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=1 << BLOCK_BITS)))).astype(np.int32), (order // len(_NEAR)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, fingerprint) numbers within RADIUS bits."""
        found = []
        for b, (at, entry) in enumerate(self.blocks):
            key = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            s = at[key]
            n = at[key + 1] - s
            hit = np.flatnonzero(n)
            n, s = n[hit], s[hit]
            window = np.repeat(hit, n)
            place = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(len(window))
            mine = entry[place]
            close = np.bitwise_count(prints[window] ^ self.prints[mine]) <= RADIUS
            found.append(np.stack([window[close], mine[close]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]


def _grams(hashes: np.ndarray) -> np.ndarray:
    w = flat.Words.__new__(flat.Words)
    w.at = np.array([0, len(hashes)])
    return flat.shingles(w, hashes)[0]


def bag(hashes: np.ndarray) -> Counter:
    """The weighted shingles of a word sequence."""
    return Counter(_grams(hashes).tolist()) if len(hashes) else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of the lesser counts by sum of the greater."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def index_bytes(words: int) -> int:
    """About what an item of so many words takes in an index: its fingerprints in all blocks, its grams and its shingle bag."""
    return size_class(words)[1] * (BLOCKS * len(_NEAR) * 4 + 64) + 250 * words


def n_words(text: str) -> int:
    """The words of an item, parted as the operator parts them."""
    return int(flat.Words(next(flat.texts(pa.array([text], pa.string())))).counts[0])


class Index:
    """Fingerprints of the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.bags, sequences = [], [], [], []
        self.classes: dict[tuple[int, int], SizeClass] = {}
        entries: dict[tuple[int, int], list] = {}
        for t in flat.texts(pa.array([x for _, x in items], pa.string())):
            words = flat.Words(t)
            hashes = flat.span_hash(t.data, words.starts, words.ends)
            for r in range(len(t)):
                own = hashes[words.at[r] : words.at[r + 1]]
                if not len(own):
                    continue
                key = size_class(len(own))
                feats = features(own, key[0] > 3)
                n = key[0] - (key[0] > 3)
                prints = BitSums(feats, n).fingerprints(np.arange(key[1]), n)
                entries.setdefault(key, []).extend((p, len(self.ids), o) for o, p in enumerate(prints.tolist()))
                self.ids.append(items[t.first + r][0])
                self.words.append(len(own))
                self.bags.append(bag(own))
                sequences.append(own)
        for key, own in sorted(entries.items()):
            self.classes[key] = c = SizeClass(*key, np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own], np.int32), np.array([x[2] for x in own], np.int32))
            c.enter()
        grams = [(g, i, q) for i, own in enumerate(sequences) if len(own) >= flat.SHINGLE for q, g in enumerate(_grams(own).tolist())]
        grams.sort()
        self.grams = np.array([x[0] for x in grams], np.uint64)
        self.gram_owner, self.gram_place = np.array([x[1] for x in grams], np.int64), np.array([x[2] for x in grams], np.int64)
        self.n_grams = np.array([max(1, n - flat.SHINGLE + 1) for n in self.words], np.int64)

    def edges(self, words: flat.Words, hashes: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(row, item number, first word) of windows at the start or end of a text that may reach the threshold."""
        if not len(self.grams) or not len(hashes):
            return
        values, at = flat.shingles(words, hashes)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(values)) - at[row]
        longest = int(self.n_grams.max()) + SHIFT
        near = np.flatnonzero((place < longest) | (place >= np.diff(at)[row] - longest))
        low = np.searchsorted(self.grams, values[near])
        n = np.searchsorted(self.grams, values[near], side="right") - low
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at_gram = np.repeat(near, n)
        row, p, item, q = row[at_gram], place[at_gram], self.gram_owner[entry], self.gram_place[entry]
        size, k = np.diff(at)[row], self.n_grams[item]
        for side in (p < k + SHIFT, p >= size - k - SHIFT):
            pair, count = np.unique(np.unique(np.stack([row[side], item[side], p[side]]), axis=1)[:2], axis=1, return_counts=True)
            enough = pair[:, count >= threshold * self.n_grams[pair[1]]]
            if not enough.shape[1]:
                continue
            mine = np.flatnonzero(side & np.isin(row * len(self.ids) + item, enough[0] * len(self.ids) + enough[1]))
            found = np.stack([np.concatenate([row[mine]] * (2 * SHIFT + 1)), np.concatenate([item[mine]] * (2 * SHIFT + 1)), np.concatenate([np.maximum(0, p[mine] - q[mine] + d) for d in range(-SHIFT, SHIFT + 1)])])
            keep = (found[2] <= SHIFT) | (found[2] + self.n_grams[found[1]] >= np.diff(at)[found[0]] - SHIFT)
            yield from map(tuple, np.unique(found[:, keep], axis=1).T.tolist())

    def matches(self, t: flat.Texts, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item number, first word, words, similarity) of each item that a text holds."""
        words = flat.Words(t)
        hashes = flat.span_hash(t.data, words.starts, words.ends)
        counts, best = words.counts, {}
        sums: dict[tuple[bool, int], BitSums] = {}
        longest = max((c.length for c in self.classes.values()), default=0)
        for c in self.classes.values():
            pairs = c.length > 3
            n = c.length - pairs
            if len(hashes) < c.length:
                continue
            key = (pairs, 0)
            if key not in sums:
                sums[key] = BitSums(features(hashes, pairs), longest)
            windows = np.maximum(0, (counts - c.length) // c.stride + 1)
            row = np.repeat(np.arange(len(t)), windows)
            first = words.at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * c.stride
            if not len(first):
                continue
            hit, entry = c.near(sums[key].fingerprints(first, n))
            for r, q, e in sorted(set(zip(row[hit].tolist(), first[hit].tolist(), entry.tolist(), strict=True))):
                item, s, stop = int(c.owner[e]), int(words.at[r]), int(words.at[r + 1])
                for p in range(q - int(c.offset[e]) - SHIFT, q - int(c.offset[e]) + SHIFT + 1):
                    p = max(p, s)
                    if (r, item) in best and best[r, item][0] == 1.0:
                        break
                    if (got := similarity(bag(hashes[p : min(p + self.words[item], stop)]), self.bags[item])) >= threshold:
                        was = best.get((r, item), (0.0, 0))
                        best[r, item] = max(was, (got, s - p), key=lambda x: x)
        for r, item, first in self.edges(words, hashes, threshold):
            if (r, item) in best and best[r, item][0] == 1.0:
                continue
            s, stop = int(words.at[r]), int(words.at[r + 1])
            if (got := similarity(bag(hashes[s + first : min(s + first + self.words[item], stop)]), self.bags[item])) >= threshold:
                best[r, item] = max(best.get((r, item), (0.0, 0)), (got, -first))
        for (r, item), (got, back) in sorted(best.items()):
            yield r, item, -back, self.words[item], got


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The benchmark's items as indexes of about INDEX_BYTES, in order of id; only the one being built is held."""
    block, held = [], 0
    for r in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("x")).where("x is not null").orderBy("i", "x").toLocalIterator():
        size = index_bytes(n_words(r["x"])) + len(r["x"])
        if block and held + size > INDEX_BYTES:
            yield Index(block)
            block, held = [], 0
        block.append((r["i"], r["x"]))
        held += size
    if block:
        yield Index(block)


def _each_index(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Each index, and whether it is the last."""
    before = None
    for index in indexes(benchmark):
        if before is not None:
            yield before, False
        before = index
    if before is not None:
        yield before, True


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of every benchmark item found in a text."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, first_word long, n_words long, similarity double"

    def scan(shared) -> DataFrame:
        def kernel():
            own = shared.value

            def each(batch):
                rows = [(t.first + r, *x) for t in flat.texts(batch.column(1)) for r, *x in own.matches(t, threshold)]
                if rows:
                    at, item, first, n, got = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([own.ids[i] for i in item], pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(got, pa.float64())], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

            return each

        return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")), kernel, schema)

    found = []
    for index, last in _each_index(benchmark):
        shared = spark.sparkContext.broadcast(index)
        found.append(scan(shared))
        if not last:
            found[-1] = written(spark, found[-1], "leaks")
            shared.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; columns as they are."""
    spark = docs.sparkSession
    for index, last in _each_index(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def kernel(shared=shared):
            own = shared.value

            def keep(column):
                out = np.ones(len(column), bool)
                for t in flat.texts(column):
                    out[[t.first + m[0] for m in own.matches(t, threshold)]] = False
                return out

            return keep

        docs = filter_rows(docs, text, kernel)
        if not last:
            docs = written(spark, docs, "clean")
            shared.destroy()
    return docs
