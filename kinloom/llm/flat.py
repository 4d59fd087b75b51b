"""Flat-buffer text kernels.

A batch of texts is one byte array with row offsets, so that words, hashes and
shingles of thousands of texts are computed by whole-array numpy steps. Words
are the maximal runs of bytes other than x20 and x09-x0D; A-Z is lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_MULT) + U64((seed * 0xD1342543DE82EF95 + 1) & _MASK))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE_CODE = seeds(256, 1)[LOWER]

_powers = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    if len(_powers["p"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _MULT), ("q", pow(_MULT, -1, 1 << 64))):
            out = np.full(n, base, U64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[key] = out
    return _powers["p"], _powers["q"]


class Texts:
    """Rows [first, last) of a batch as bytes: text r is data[offs[r]:offs[r+1]]; nulls are empty."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int, valid: np.ndarray):
        self.data, self.offs, self.first, self.valid = data, offs, first, valid

    def __len__(self) -> int:
        return len(self.offs) - 1

    def string(self, r: int) -> str:
        return self.data[self.offs[r] : self.offs[r + 1]].tobytes().decode("utf-8", "replace")


def texts(column: pa.Array, chunk: int = 0) -> Iterator[Texts]:
    """A string column as chunks of about CHUNK_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    valid = np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return
    _, offsets, raw = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at, step = 0, chunk or CHUNK_BYTES
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + step, "right")) - 1)
        to = min(to, len(column))
        yield Texts(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at, valid[at:to])
        at = to


class Words:
    """Word starts and ends (byte positions) and, for each text, where its words begin: words of r are at[r]:at[r+1]."""

    def __init__(self, t: Texts):
        n, offs = len(t.data), t.offs
        space = SPACE[t.data]
        after = np.empty(n + 1, bool)
        after[0] = True
        after[1:] = space
        after[offs] = True
        self.starts = np.flatnonzero(after[:-1] & ~space)
        before = np.empty(n + 1, bool)
        before[:-1] = space
        before[n] = True
        before[offs] = True
        self.ends = np.flatnonzero(before[1:] & ~space) + 1
        self.at = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased byte spans; equal spans have equal hashes wherever they stand."""
    p, q = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64))


SHINGLE = 5
_PLACE = seeds(SHINGLE + 1, 2) | U64(1)


def shingles(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in order, and each text's first position; a text of one to four words has one for its whole sequence."""
    counts, k = words.counts, SHINGLE
    n = len(hashes)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(out_counts)))
    if n >= k:
        rolled = hashes[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            rolled += hashes[j : n - k + 1 + j] * _PLACE[j]
    else:
        rolled = np.zeros(0, U64)
    take = np.repeat(words.at[:-1] - at[:-1], out_counts) + np.arange(at[-1])
    out = np.zeros(at[-1], U64)
    long = np.repeat(counts >= k, out_counts)
    out[long] = mix(rolled[take[long]])
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[words.at[r] : words.at[r + 1]]
        out[at[r]] = mix((own * _PLACE[: len(own)]).sum(dtype=U64, keepdims=True) + _PLACE[k:] * np.array([len(own)], U64))[0]
    return out, at


def distinct_sets(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and made distinct (values is sorted in place)."""
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[s:e].sort()
    keep = np.ones(len(values), bool)
    if len(values) > 1:
        keep[1:] = values[1:] != values[:-1]
        first = at[:-1]
        keep[first[first < len(values)]] = True
    sums = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], sums[at]


def shingle_sets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and their bounds."""
    words = Words(t)
    return distinct_sets(*shingles(words, span_hash(t.data, words.starts, words.ends)))


def codepoints(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and each text's bounds; invalid UTF-8 is replaced."""
    try:
        joined = t.data.tobytes().decode("utf-8")
        firsts = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), firsts[t.offs]
    except UnicodeDecodeError:
        each = [t.string(r) for r in range(len(t))]
        joined = "".join(each)
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
