"""License scan: winnowed fingerprints, then banded alignment.

Templates and texts are sequences of words. Hashes of GRAM consecutive words
are winnowed: of every WINDOW neighbouring ones the smallest is kept, so a run
of GRAM + WINDOW - 1 shared words always shares a fingerprint. An inverted
index of the templates' fingerprints (TEMPLATES, or any other name: text) gives candidates:
a template and where in the text it would begin. Each is verified by a banded
alignment (longest common subsequence within BAND words of the diagonal); the
share of the template's words that match is its coverage.

Words are runs of letters and digits, lower-cased, with dots inside kept
("2.0"; letters with a two-character lower case keep their case), so that case, line breaks and punctuation don't matter. A template of
fewer than GRAM words is one gram.

Defined results: null and empty texts hold nothing; a license found at several
places is reported at each, never twice at one place (the higher coverage,
then the template's name decides); spans are code points, ends exclusive; rows that
repeat are reported each. Only the key and the text are read, so other columns
may have any name. A very long text is handled alone, with about 50 bytes of
memory a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import flat
from kinloom.llm.common import map_batches
from kinloom.llm.license_templates import TEMPLATES

GRAM, WINDOW, BAND = 3, 2, 8
THRESHOLD = 0.75

_PLACE = flat.seeds(GRAM + 1, 51) | np.uint64(1)


#: Code point -> 1 word character, 2 other, 0 not met yet; and its lower case where that is one character.
_kind = np.zeros(0x110000, np.uint8)
_lower = np.arange(0x110000, dtype=np.uint32)


def _kinds(points: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits (as str.isalnum says)."""
    out = _kind[points]
    if not out.all():
        for p in np.unique(points[out == 0]).tolist():
            c = chr(p)
            _kind[p] = 1 if c.isalnum() else 2
            if len(c.lower()) == 1:
                _lower[p] = ord(c.lower())
        out = _kind[points]
    return out == 1


def words_of(t: flat.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, their starts and ends in the text's code points, and where each text's words begin."""
    points, at = flat.codepoints(t)
    n = len(points)
    word = _kinds(points)
    # A dot between two word characters of one text belongs to the word; a text's first and last character have no neighbour.
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    dot = np.flatnonzero(points == 46)
    dot = dot[(dot > 0) & (dot < n - 1)]
    dot = dot[word[dot - 1] & word[dot + 1] & ~edge[dot] & ~edge[dot + 1]]
    inside = word.copy()
    inside[dot] = True
    after = np.concatenate(([True], ~inside)) | edge
    starts = np.flatnonzero(after[:-1] & inside)
    before = np.concatenate((~inside, [True])) | edge
    ends = np.flatnonzero(before[1:] & inside) + 1
    p, q = flat._power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(flat.mix(_lower[points].astype(np.uint64) + _PLACE[0]) * p[:n], out=sums[1:])
    hashes = flat.mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, at)
    base = np.repeat(at[:-1], np.diff(first))
    return hashes, starts - base, ends - base, first


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their (start, end) in code points."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    hashes, starts, ends, _ = words_of(next(flat.texts(pa.array([text], pa.string()))))
    return hashes, np.stack([starts, ends], axis=1)


def grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of GRAM consecutive words; of a shorter sequence one for all of it."""
    if len(hashes) < GRAM:
        return flat.mix((hashes * _PLACE[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[GRAM]) if len(hashes) else hashes
    out = hashes[: len(hashes) - GRAM + 1] * _PLACE[0]
    for j in range(1, GRAM):
        out += hashes[j : len(hashes) - GRAM + 1 + j] * _PLACE[j]
    return flat.mix(out)


def winnowed(values: np.ndarray) -> np.ndarray:
    """Positions of the smallest (of equal ones the last) value of every WINDOW neighbours."""
    if len(values) <= WINDOW:
        return np.arange(len(values)) if len(values) < WINDOW else np.array([len(values) - 1 - int(values[::-1].argmin())])
    windows = np.lib.stride_tricks.sliding_window_view(values, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))


def align(template: np.ndarray, words: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matched words, first, last matched position + 1) of the longest common subsequence within BAND of a diagonal (text position = template position + diagonal)."""
    width = 2 * BAND + 1
    best = np.zeros((len(template) + 1, width + 1), np.int64)  # cell b of row i: text prefix of i + diagonal - BAND + b words
    equal = np.zeros((len(template), width + 1), bool)
    for i, h in enumerate(template):
        at = np.arange(i + diagonal - BAND, i + diagonal + BAND + 1)
        inside = (at >= 0) & (at < len(words))
        equal[i, :width][inside] = words[at[inside]] == h
        # Row i + 1, cell b is the prefix ending after text word `at[b]`; row i's cell b is the prefix before it.
        row = best[i, :width] + equal[i, :width]
        row = np.maximum(row, np.append(best[i, 1:width], best[i, width - 1]))
        best[i + 1, :width] = np.maximum.accumulate(row)
    i, b = len(template), int(best[-1, :width].argmax())
    total, first, last = int(best[-1, b]), -1, -1
    while i and best[i, b]:
        if b and best[i, b - 1] == best[i, b]:
            b -= 1
        elif equal[i - 1, b] and best[i - 1, b] + 1 == best[i, b]:
            first = i - 1 + diagonal - BAND + b
            last = max(last, first + 1)
            i -= 1
        else:
            i, b = i - 1, min(b + 1, width - 1)
    return total, first, last


@dataclass
class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    names: list[str]
    words: list[np.ndarray]
    places: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @staticmethod
    def of(templates: dict[str, str]) -> Index:
        index = Index(sorted(templates), [word_hashes(templates[k])[0] for k in sorted(templates)])
        for n, words in enumerate(index.words):
            values = grams(words)
            for p in winnowed(values).tolist() if len(words) >= GRAM + WINDOW - 1 else range(len(values)):
                index.places.setdefault(int(values[p]), []).append((n, p))
        index.keys = np.sort(np.array(list(index.places), np.uint64))
        return index

    def found(self, t: flat.Texts, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, template, coverage, matched words, start, end) found in a chunk; only texts with a gram of the index are looked at one by one."""
        hashes, starts, ends, first = words_of(t)
        counts = np.diff(first)
        if not len(hashes) or not len(self.keys):
            return
        values = grams(hashes)
        near = self.keys[np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)] == values
        rows = set((np.searchsorted(first, np.flatnonzero(near), "right") - 1).tolist())
        rows |= set(np.flatnonzero((counts > 0) & (counts < GRAM)).tolist())  # such a text is one gram
        for r in sorted(rows):
            own = slice(first[r], first[r + 1])
            for m in self.aligned(hashes[own], starts[own], ends[own], threshold):
                yield r, *m

    def matches(self, text: str, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(template, coverage, matched words, start, end) found in a text."""
        words, spans = word_hashes(text)
        return self.aligned(words, spans[:, 0], spans[:, 1], threshold)

    def aligned(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> list[tuple[int, float, int, int, int]]:
        values = grams(words)
        if not len(values):
            return []
        # A text's own winnowing meets long templates; grams of templates too short to winnow are looked up at every place.
        hit = np.flatnonzero(np.isin(values, self.keys))
        if not len(hit):
            return []
        kept = np.zeros(len(values), bool)
        kept[winnowed(values)] = True
        tried, found = set(), []
        for p in hit.tolist():
            for n, q in self.places[int(values[p])]:
                if not kept[p] and len(self.words[n]) >= GRAM + WINDOW - 1:
                    continue
                if any((n, p - q + d) in tried for d in range(-BAND // 2, BAND // 2 + 1)):
                    continue
                tried.add((n, p - q))
                total, first, last = align(self.words[n], words, p - q)
                if total >= threshold * len(self.words[n]):
                    found.append((total / len(self.words[n]), total, n, first, last))
        out: list[tuple] = []
        for coverage, total, n, first, last in sorted(found, key=lambda x: (-x[1] * x[0], -x[0], x[2], x[3])):
            if not any(first < e and s < last for _, _, _, s, e in out):
                out.append((n, coverage, total, first, last))
        return sorted(((n, c, t, int(starts[s]), int(ends[e - 1])) for n, c, t, s, e in out), key=lambda x: x[3])


def licensed(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, matched_words, span_start, span_end) of every license found in a text."""
    shared = df.sparkSession.sparkContext.broadcast(Index.of(templates or TEMPLATES))

    def kernel():
        own = shared.value

        def each(batch):
            rows = [(t.first + r, own.names[n], *m) for t in flat.texts(batch.column(1)) for r, n, *m in own.found(t, threshold)]
            if rows:
                at, name, coverage, total, start, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(name, pa.string()), pa.array(coverage, pa.float64()), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "license", "coverage", "matched_words", "span_start", "span_end"])

        return each

    return map_batches(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")), kernel, "doc_id long, license string, coverage double, matched_words long, span_start long, span_end long")
