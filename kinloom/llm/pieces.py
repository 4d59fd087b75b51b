"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a model file; byte pieces are the fallback for characters
that no piece covers. A file of ranked (BPE) pieces has no log-probabilities,
so ranks are turned into Zipfian log scores (see piece_scores). White space is
the marker U+2581: a space becomes the marker, and one marker is put before
the text. No piece holds a marker after another character, so a best path is
the chain of best paths of the segments that begin with a run of markers;
segments are cut there, made distinct within a chunk, and all distinct ones
are walked through the trie and the Viterbi recursion together in numpy. A
segment of over LONG_SEGMENT bytes is walked alone, block by block, with the
same result, so that a very long text without spaces holds only a back pointer
for each byte.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids (no marker is put before it). Equal scores: the longer last piece
wins. A text holding the marker itself decodes to a space there; `exact` says
whether decoding gave back the text. Rows that repeat are encoded each;
columns that are kept may have any name (see encoded).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import flat
from kinloom.llm.common import map_batches, own_names, with_text

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Zipf's offset for ranked pieces, and what a fallback byte costs beyond the least likely piece.
ZIPF_OFFSET = 2.7
BYTE_PENALTY = 10.0
NONE = -1e18
#: Bytes of text encoded at once; the recursion holds about a hundred bytes for each byte of a distinct segment.
CHUNK = 1 << 19


def piece_scores(ranks: np.ndarray) -> np.ndarray:
    """log p of pieces by rank r: p in proportion to 1 / (r + ZIPF_OFFSET)."""
    p = 1.0 / (ranks + ZIPF_OFFSET)
    return np.log(p / p.sum())


class DoubleArray:
    """A double-array trie over bytes: from state s by byte b to base[s] + b + 1 where check is s; value is the piece number or -1."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for number, key in enumerate(keys):
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = number
        size = 1 << 17
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        todo, hint, top = [(0, root)], 1, 1
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            codes = np.array(sorted(b + 1 for b in node if b >= 0), np.int64)
            if not len(codes):
                base[state] = -300  # no child: every step leaves the array's checked part
                continue
            while True:
                if hint + 4096 + 300 >= size:
                    size *= 2
                    base, check, value, free = np.resize(base, size), np.append(check, np.full(size - len(check), -1, np.int32)), np.append(value, np.full(size - len(value), -1, np.int32)), np.append(free, np.ones(size - len(free), bool))
                starts = np.arange(hint, hint + 4096)
                fits = free[starts + codes[0]]
                for c in codes[1:]:
                    fits &= free[starts + c]
                hit = np.flatnonzero(fits)
                if len(hit):
                    break
                hint += 4096
            at = int(starts[hit[0]])
            base[state] = at
            free[at + codes] = False
            check[at + codes] = state
            top = max(top, int(at + codes[-1]))
            while hint < at and not free[hint : hint + 64].any():
                hint += 64
            todo += [(at + b + 1, child) for b, child in node.items() if b >= 0]
        self.base, self.check, self.value = base[: top + 1].copy(), check[: top + 1].copy(), value[: top + 1].copy()

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[states] + codes.astype(np.int32) + 1
        to[(to < 0) | (to >= len(self.check))] = 0
        return np.where(self.check[to] == states, to, -1)


@dataclass
class Vocabulary:
    trie: DoubleArray
    ids: np.ndarray  # piece number -> id
    scores: np.ndarray  # piece number -> log score
    longest: int
    byte_ids: np.ndarray
    byte_score: float
    unknown: int
    bytes_of: dict[int, bytes]

    @staticmethod
    def of(pieces: list[tuple[int, str, float]], byte_ids: dict[int, int], unknown: int = 0) -> Vocabulary:
        """From (id, piece, log score) and byte -> id (may be empty: then uncovered characters become `unknown`)."""
        keys = [p.encode() for _, p, _ in pieces]
        scores = np.array([s for _, _, s in pieces])
        table = np.full(256, unknown, np.int32)
        for b, i in byte_ids.items():
            table[b] = i
        bytes_of = {i: k for (i, _, _), k in zip(pieces, keys, strict=True)} | {i: bytes([b]) for b, i in byte_ids.items()}
        return Vocabulary(DoubleArray(keys), np.array([i for i, _, _ in pieces], np.int32), scores, max(map(len, keys)), table, float(scores.min() - BYTE_PENALTY), unknown, bytes_of)


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    own = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    raw = np.array([m.get_score(i) for i in own])
    ranked = bool((raw == np.round(raw)).all()) and math.isclose(raw.min(), 1 - len(own), rel_tol=0.01)
    scores = piece_scores(-raw) if ranked else raw
    return Vocabulary.of([(i, m.id_to_piece(i), float(s)) for i, s in zip(own, scores, strict=True)], byte_ids, m.unk_id())


def viterbi(v: Vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best ids of the byte strings data[at[k]:at[k+1]] (UTF-8, markers in place), and their bounds."""
    n, size = len(at) - 1, np.diff(at)
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    lead = (data & 0xC0) != 0x80
    begin = np.flatnonzero(lead)
    stop = np.repeat(at[1:], size)  # the end of each byte's string
    width = np.diff(np.append(begin, total))
    covered = np.zeros(total, bool)
    # All trie matches: walk every character start at once, one byte deeper each round.
    pos, state, found = begin, np.zeros(len(begin), np.int32), []
    char_end = np.zeros(total, np.int64)
    char_end[begin] = begin + width
    for depth in range(v.longest):
        inside = pos + depth < stop[pos]
        pos, state = pos[inside], state[inside]
        state = v.trie.step(state, data[pos + depth])
        live = state >= 0
        pos, state = pos[live], state[live]
        if not len(pos):
            break
        number = v.trie.value[state]
        hit = number >= 0
        found.append((pos[hit], pos[hit] + depth + 1, number[hit]))
        covered[pos[hit][char_end[pos[hit]] == pos[hit] + depth + 1]] = True
    lone = begin[~covered[begin]]
    found.append((lone, char_end[lone], np.full(len(lone), -1)))
    first, last, number = (np.concatenate(x) for x in zip(*found, strict=True))
    score = np.where(number >= 0, v.scores[number], v.byte_score * (last - first))
    # Forward recursion over the offset of a match's end within its string, all strings together. Within a round ends differ by string and start.
    offset = last - (np.repeat(at[:-1], size)[first])
    order = np.lexsort((-first, last, offset))
    first, last, number, score, offset = first[order], last[order], number[order], score[order], offset[order]
    best = np.full(total + n + 1, NONE)  # string k's positions are at[k] + k ... at[k+1] + k
    shift = np.repeat(np.arange(n), size)
    best[at[:-1] + np.arange(n)] = 0
    back = np.zeros(total + n + 1, np.int64)
    cuts = np.flatnonzero(np.diff(offset)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(offset)], strict=True):
        f = first[s:e]
        reach = best[f + shift[f]] + score[s:e]
        to = last[s:e] + shift[f]
        heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        top = np.maximum.reduceat(reach, heads)
        where = np.flatnonzero(reach == np.repeat(top, np.diff(np.append(heads, e - s))))
        where = where[::-1]  # of equal scores the earliest start, the longer piece, is written last
        best[to[where]] = reach[where]
        where = np.sort(where)
        far = where[np.append(np.diff(to[where]) != 0, True)]
        back[to[far]] = s + far
    # Trace back, all strings together.
    here, string, steps = at[1:] + np.arange(n), np.arange(n), []
    alive = size > 0
    here, string = here[alive], string[alive]
    while len(here):
        m = back[here]
        steps.append((string, m))
        here = first[m] + string
        more = first[m] > at[string]
        here, string = here[more], string[more]
    who = np.concatenate([x[0] for x in steps])[::-1]
    edges = np.concatenate([x[1] for x in steps])[::-1]
    order = np.argsort(who, kind="stable")
    who, edges = who[order], edges[order]
    # Byte fallback: one id for each byte of an uncovered character.
    many = np.where(number[edges] >= 0, 1, last[edges] - first[edges])
    out = np.repeat(np.where(number[edges] >= 0, v.ids[number[edges]], 0), many).astype(np.int32)
    loose = np.repeat(number[edges] < 0, many)
    place = np.repeat(first[edges] - (np.cumsum(many) - many), many) + np.arange(len(out))
    out[loose] = v.byte_ids[data[place[loose]]]
    return out, np.concatenate(([0], np.cumsum(np.bincount(who, weights=many, minlength=n).astype(np.int64))))


#: Bytes from which a segment is walked alone.
LONG_SEGMENT = 1 << 16


def long_viterbi(v: Vocabulary, data: np.ndarray, block: int = LONG_SEGMENT) -> np.ndarray:
    """Best ids of one byte string, as viterbi gives them, with twelve bytes held for each byte and matches only of a block of starts."""
    n = len(data)
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    char_end = np.append(begin[1:], n)
    back, piece = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
    reach = {0: 0.0}  # the best score of each position from the block's start on
    for s in range(0, len(begin), block):
        own, own_end = begin[s : s + block], char_end[s : s + block]
        pos, state, found = own, np.zeros(len(own), np.int32), []
        lone = np.ones(len(own), bool)
        for depth in range(v.longest):
            inside = pos + depth < n
            pos, state = pos[inside], state[inside]
            state = v.trie.step(state, data[pos + depth])
            live = state >= 0
            pos, state = pos[live], state[live]
            if not len(pos):
                break
            number = v.trie.value[state]
            hit = number >= 0
            found.append((pos[hit], pos[hit] + depth + 1, number[hit]))
            which = np.searchsorted(own, pos[hit])
            lone[which[own_end[which] == pos[hit] + depth + 1]] = False
        found.append((own[lone], own_end[lone], np.full(int(lone.sum()), -1)))
        first, last, number = (np.concatenate(x) for x in zip(*found, strict=True))
        score = np.where(number >= 0, v.scores[number], v.byte_score * (last - first))
        order = np.lexsort((last, first))
        for f, e, p, x in zip(first[order].tolist(), last[order].tolist(), number[order].tolist(), score[order].tolist(), strict=True):
            x += reach[f]
            if e not in reach or x > reach[e]:
                reach[e], back[e], piece[e] = x, f, p
        stop = int(own_end[-1])
        reach = {e: x for e, x in reach.items() if e >= stop}
    out, at = [], n
    while at:
        f, p = int(back[at]), int(piece[at])
        out.append([int(v.ids[p])] if p >= 0 else v.byte_ids[data[f:at]].tolist())
        at = f
    return np.array([i for ids in reversed(out) for i in ids], np.int32)


def walked(v: Vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """viterbi, with long segments walked alone."""
    long = np.flatnonzero(np.diff(at) > LONG_SEGMENT)
    if not len(long):
        return viterbi(v, data, at)
    parts, s = [], 0
    for k in [*long.tolist(), len(at) - 1]:
        parts.append(viterbi(v, data[at[s] : at[k]], at[s : k + 1] - at[s]))
        if k < len(at) - 1:
            ids = long_viterbi(v, data[at[k] : at[k + 1]])
            parts.append((ids, np.array([0, len(ids)])))
        s = k + 1
    return np.concatenate([x[0] for x in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[1]) for x in parts]))))


#: Encoded segments that a task keeps for later chunks.
HELD_SEGMENTS = 1 << 17


def _gathered(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[at[r]:at[r+1]] of the given rows, one after another, and their bounds."""
    counts = at[rows + 1] - at[rows]
    to = np.concatenate(([0], np.cumsum(counts)))
    return values[np.repeat(at[rows] - to[:-1], counts) + np.arange(to[-1])], to


class Held:
    """Ids of segments by hash: the first HELD_SEGMENTS distinct ones of a task, so that common words are walked once."""

    def __init__(self):
        self.keys, self.ids, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, hashes: np.ndarray, walk) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds for sorted distinct hashes; walk(rows) encodes those that aren't held."""
        place = np.searchsorted(self.keys, hashes)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == hashes[known]
        new = np.flatnonzero(~known)
        ids, at = walk(new)
        row = np.empty(len(hashes), np.int64)
        row[known] = place[known]
        row[new] = len(self.keys) + np.arange(len(new))
        values, bounds = np.concatenate((self.ids, ids)), np.concatenate((self.at, self.at[-1] + at[1:]))
        out = _gathered(values, bounds, row)
        if len(new) and len(self.keys) < HELD_SEGMENTS:
            keys = np.concatenate((self.keys, hashes[new]))
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.ids, self.at = _gathered(values, bounds, order)
        return out


def encode(v: Vocabulary, t: flat.Texts, held: Held | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk in a row, and their bounds."""
    rows, sizes = len(t), np.diff(t.offs)
    # Text as bytes with markers: one before each non-empty text, three bytes for each space.
    filled = sizes > 0
    space = t.data == 0x20
    lengths = np.where(space, 3, 1)
    lengths_at = np.concatenate(([0], np.cumsum(lengths)))
    bounds = lengths_at[t.offs] + 3 * np.concatenate(([0], np.cumsum(filled)))
    data = np.empty(bounds[-1], np.uint8)
    row_of = np.repeat(np.cumsum(filled), sizes)
    to = lengths_at[:-1] + 3 * row_of
    data[to[~space]] = t.data[~space]
    marks = np.sort(np.concatenate((to[space], bounds[:-1][filled])))
    for j in range(3):
        data[marks + j] = MARK[j]
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    # Segments begin at a marker that does not follow a marker (of the text itself too), or at a text's begin.
    is_mark = np.zeros(len(data) + 3, bool)
    if len(data) >= 3:
        is_mark[: len(data) - 2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    head = is_mark[: len(data)].copy()
    head[3:] &= ~is_mark[: len(data) - 3]
    head[bounds[:-1][filled]] = True
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(data))
    hashes = _raw_hash(data, starts, ends)
    distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)

    def walk(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = starts[one[rows]]
        size = ends[one[rows]] - begin
        seg_at = np.concatenate(([0], np.cumsum(size)))
        return walked(v, data[np.repeat(begin - seg_at[:-1], size) + np.arange(seg_at[-1])], seg_at)

    ids, ids_at = (held or Held()).encode(distinct, walk)
    counts = np.diff(ids_at)[which]
    out_at = np.concatenate(([0], np.cumsum(counts)))
    out = ids[np.repeat(ids_at[:-1][which] - out_at[:-1], counts) + np.arange(out_at[-1])]
    return out, out_at[np.searchsorted(starts, bounds)]


_CASED = flat.seeds(256, 11)


def _raw_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As flat.span_hash, but with letter case."""
    p, q = flat._power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CASED[data] * p[: len(data)], out=total[1:])
    return flat.mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


class Decoder:
    """Ids to bytes, a whole chunk at once."""

    def __init__(self, v: Vocabulary):
        top = max(v.bytes_of, default=0) + 1
        parts = [v.bytes_of.get(i, b"").replace(MARK, b" ") for i in range(top)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts and their bounds; the marker put before each is taken off."""
        size = self.size[ids]
        to = np.concatenate(([0], np.cumsum(size)))
        data = self.data[np.repeat(self.at[ids] - to[:-1], size) + np.arange(to[-1])]
        bounds = to[at]
        drop = bounds[:-1][np.diff(bounds) > 0]
        drop = drop[data[drop] == 0x20]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return data[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def encoded(df: DataFrame, v: Vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of df with ids (array of int), n_pieces, n_bytes (fallback bytes among them) and exact (decoding gives the text back).

    A kept column of one of these names stays as it is; the operator's own then has an underscore behind its name.
    """
    shared = df.sparkSession.sparkContext.broadcast(v)
    rows_of, fields = with_text(df, keep, text)
    names = own_names(["ids", "n_pieces", "n_bytes", "exact"], keep)

    def kernel():
        own = shared.value
        decode, held = Decoder(own), Held()
        is_byte = np.zeros(max(own.bytes_of, default=0) + 1, bool)
        is_byte[own.byte_ids] = True

        def each(batch):
            for t in flat.texts(batch.column(len(keep)), CHUNK):
                ids, at = encode(own, t, held)
                back, bounds = decode(ids, at)
                same = np.diff(bounds) == np.diff(t.offs)
                differs = np.ones(len(t), bool)
                if same.all():
                    wrong = np.concatenate(([0], np.cumsum(back != t.data)))
                    differs = np.diff(wrong[t.offs]) > 0
                else:
                    for r in np.flatnonzero(same):
                        differs[r] = not np.array_equal(back[bounds[r] : bounds[r + 1]], t.data[t.offs[r] : t.offs[r + 1]])
                fell = np.concatenate(([0], np.cumsum(is_byte[ids])))
                n = np.diff(at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(~t.valid)) if not t.valid.all() else pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                rows = batch.slice(t.first, len(t)).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*rows, lists, pa.array(n, mask=~t.valid), pa.array(np.diff(fell[at]), mask=~t.valid), pa.array(~differs, mask=~t.valid)], [*keep, *names])

        return each

    own_fields = [f"`{n}` {t}" for n, t in zip(names, ("array<int>", "long", "long", "boolean"), strict=True)]
    return map_batches(rows_of, kernel, ", ".join([*filter(None, [fields]), *own_fields]))


def decoded(df: DataFrame, v: Vocabulary, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns `keep` of df with text, decoded from an array of ids; bytes that are no UTF-8 become U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(v)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    name, source = own_names(["text", "_ids"], keep)

    def kernel():
        decode = Decoder(shared.value)

        def each(batch):
            column = batch.column(len(keep))
            rows = column.to_pylist()
            at = np.concatenate(([0], np.cumsum([len(x or ()) for x in rows], dtype=np.int64)))
            data, bounds = decode(np.array([i for x in rows for i in x or ()], np.int64), at)
            texts = [None if x is None else data[s:e].tobytes().decode("utf-8", "replace") for x, s, e in zip(rows, bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, name])

        return each

    return map_batches(df.select(*keep, F.col(ids).alias(source)), kernel, ", ".join([*fields, f"`{name}` string"]))
