"""Near-duplicate classes by b-bit MinHash, verified on full shingle sets.

1. One pass over the texts gives each document its set's size and a 128-bit
   fingerprint, 512 minima cut to their low four bits and packed (256 bytes),
   and 32 band keys of four whole minima each.
2. Documents with equal sets form a class, a node from here on.
3. Band buckets are compared tile by tile: the packed signatures estimate the
   similarity by bit counts, corrected for chance collisions, and pairs up to
   five standard deviations below the threshold pass. A bucket of more than a
   tile is first compared with its least node; what is like that is one
   component, and only the rest is compared with all. A tile emits only a
   forest of its passing pairs, fewer than its members; connected components
   of the forests are candidate groups, and every passing pair lies within one.
4. Groups are verified in the same way on the full sets: pairs whose estimate
   passes are compared exactly, and a tile emits a forest of its links.
5. Connected components of the links.

So no pair table is ever made, and no key's rows meet in one task: rows are
dealt to tiles before they are copied, and joins on hot keys broadcast the few
keys that are hot.

A link of similarity 0.75 shares a band with probability 1 - 5e-6 and passes
the estimate with 1 - 3e-7; nothing else is dropped. Words and shingles are
64-bit hashes.

Defined results: null, empty and wordless texts have an empty set, are linked
with nothing and are kept; one to four words are one shingle. Every row is a
document: rows with equal ids (or none) and different texts are compared and
may be kept each; a class's first document has its smallest id, rows without
one come last, and of one id the smallest text hash is first. component_id is
that first id, null if no document of the class has one. Rows equal in id and
text are copies: each is returned, and one stays. Other columns are not read,
so they may have any name. A very long text is shingled alone, with about 60
bytes of memory a byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from kinloom.llm import flat
from kinloom.llm.common import map_batches, own_names, written
from kinloom.operators.components import linked, with_keyed
from kinloom.scratch import dense_id

MINIMA = 512
LOW_BITS = 4
BANDS, ROWS = 32, 4
#: Estimates may err by this many standard deviations before a link could be lost.
SIGMAS = 5.0
#: Members of a group that meet in one tile.
TILE = 256
TILE_BYTES = 8 << 20
#: Ids are broadcast up to this many (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000

_A = flat.seeds(MINIMA, 31) | np.uint64(1)
_B = flat.seeds(MINIMA, 32)
_BAND = flat.seeds(BANDS * ROWS, 33).reshape(BANDS, ROWS) | np.uint64(1)
_CHANCE = 2.0**-LOW_BITS


def cutoff(threshold: float) -> float:
    """The least share of equal low-bit minima that a link may show."""
    p = _CHANCE + (1 - _CHANCE) * threshold
    return p - SIGMAS * math.sqrt(p * (1 - p) / MINIMA)


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, MINIMA) minima of non-empty sets."""
    out = np.empty((len(at) - 1, MINIMA), np.uint64)
    buffer = np.empty(len(sets), np.uint64)
    for k in range(MINIMA):
        np.multiply(sets, _A[k], out=buffer)
        buffer += _B[k]
        out[:, k] = np.minimum.reduceat(buffer, at[:-1])
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, sixteen to a 64-bit word."""
    per = 64 // LOW_BITS
    low = (flat.mix(mins) & np.uint64((1 << LOW_BITS) - 1)).reshape(len(mins), MINIMA // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=2)


def equal_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal low-bit minima of packed signatures, by bit counts of their difference."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 1 - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64) / MINIMA


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, corrected for chance collisions."""
    return (equal_share(a, b) - _CHANCE) / (1 - _CHANCE)


def _binary(values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix of 64-bit words as binary values."""
    width = values.shape[1] * 8
    offs = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _words64(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as a matrix of 64-bit words."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(len(column), -1)


def sketches(docs: DataFrame) -> DataFrame:
    """doc, digest, n_shingles, bytes, k1, k2 (fingerprint of the set), sig, bands (array of long) of rows (doc, digest, text)."""

    def kernel():
        def each(batch):
            for t in flat.texts(batch.column(2)):
                sets, at = flat.shingle_sets(t)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((2, len(t)), np.uint64)
                sig = np.zeros((len(t), MINIMA * LOW_BITS // 64), np.uint64)
                bands = np.zeros((len(t), BANDS), np.uint64)
                if len(full):
                    first = at[:-1][full]
                    for j in (0, 1):
                        keys[j, full] = np.add.reduceat(flat.mix(sets ^ flat.seeds(2, 34)[j]), first)
                    mins = minima(sets, np.append(first, at[-1]))
                    sig[full] = packed(mins)
                    rows = mins[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                    bands[full] = flat.mix((flat.mix(rows) * _BAND).sum(axis=2, dtype=np.uint64) + flat.seeds(BANDS, 35))
                counts = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(bands[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(t.first, len(t)) for c in batch.columns[:2]), pa.array(n), pa.array(np.diff(t.offs)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), _binary(sig), lists], ["doc", "digest", "n_shingles", "bytes", "k1", "k2", "sig", "bands"])

        return each

    return map_batches(docs.select("doc", "digest", "text"), kernel, "doc long, digest long, n_shingles long, bytes long, k1 long, k2 long, sig binary, bands array<long>")


def only(df: DataFrame, ids: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df with (or without) a key of ids (columns of the same names; nulls are equal): broadcast up to BROADCAST_IDS distinct keys, shuffled beyond."""
    other = ids.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    match = reduce(and_, [df[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(F.broadcast(other) if ids.count() <= BROADCAST_IDS else other, match, how)


def _by_tile(rows: DataFrame, kernel) -> DataFrame:
    """kernel(columns of one tile) -> pairs (a, b), for each tile (columns g, i, j) of rows; with the tile's g.

    Rows are dealt and sorted by tile; a task holds one tile and one Arrow batch.
    """

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in ("g", "i", "j"):
            k = table.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        return np.concatenate(([0], np.flatnonzero(new), [table.num_rows]))

    def tiles(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            at = bounds(rest)
            for s, e in zip(at[:-2].tolist(), at[1:-1].tolist(), strict=True):
                yield rest.slice(s, e - s)
            rest = rest.slice(at[-2])
        if rest is not None:
            yield rest

    def run(batches):
        for tile in tiles(batches):
            if tile.num_rows > 1:
                a, b = kernel({c: (col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)) for c, col in zip(tile.column_names, tile.columns, strict=True)})
                if len(a):
                    g = pa.array(np.full(len(a), tile.column("g")[0].as_py()), pa.int64())
                    yield pa.RecordBatch.from_arrays([g, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["g", "a", "b"])

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "g long, a long, b long")


def _forest(tile: dict[str, pa.Array], threshold: float, exact: bool) -> tuple[list, list]:
    """Pairs that join the tile's nodes into the components of its similar pairs, at most one less than its nodes.

    A pair is similar if its estimate passes and, where exact, its shingle sets
    reach the threshold. A tile with i < 0 is compared with itself, else its
    left rows with the others; covered nodes are known to be one component.
    """
    least, hundred = cutoff(threshold), round(threshold * 100)
    node, left, sig = tile["node"].to_numpy(), np.asarray(tile["left"]), _words64(tile["sig"])
    whole = tile["i"][0].as_py() < 0
    lefts, rights = (np.arange(len(node)),) * 2 if whole else (np.flatnonzero(left), np.flatnonzero(~left))
    part = np.unique(node, return_inverse=True)[1]
    covered = np.asarray(tile["covered"])
    if covered.any():
        part[covered] = part[covered][0]
    if exact:
        sets = []
        for t in flat.texts(tile["text"]):
            h, at = flat.shingle_sets(t)
            sets += [h[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        size = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate(([0], np.cumsum(size)))
        mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    a, b = [], []
    for n, x in enumerate(lefts.tolist()):
        other = rights[n + 1 :] if whole else rights
        other = other[part[other] != part[x]]
        if not len(other):
            continue
        other = other[equal_share(sig[other], sig[x]) >= least]
        if exact and len(other):
            mark[ids[at[x] : at[x + 1]]] = True
            counts = size[other]
            to = np.concatenate(([0], np.cumsum(counts)))
            both = np.concatenate(([0], np.cumsum(mark[ids[np.repeat(at[other] - to[:-1], counts) + np.arange(to[-1])]])))
            both = both[to[1:]] - both[to[:-1]]
            mark[ids[at[x] : at[x + 1]]] = False
            other = other[100 * both >= hundred * (size[x] + counts - both)]
        for y in other.tolist():
            if part[y] != part[x]:
                a.append(node[x])
                b.append(node[y])
                part[part == part[y]] = part[x]
    return a, b


def _dealt(rows: DataFrame, by: str, parts: str) -> DataFrame:
    """Rows with chunk (a hash of the node, mod column `parts`), dealt by group and chunk before a copy is made of any."""
    return rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")).repartition(by, "chunk")


def _similar(spark: SparkSession, members: DataFrame, payload: Callable[[DataFrame, bool], DataFrame], threshold: float, exact: bool) -> DataFrame:
    """(a, b): a forest over each group that joins what its similar pairs join.

    members: (g, node) with the group's rows n, tiles t and least node first.
    payload(tiles, large) gives a tile's rows their signatures and, where exact,
    texts. A group of one tile is compared with itself. Of a larger one all
    nodes are compared with the first, in t tiles; those like it are one
    component, so only the others (few, in a group of near copies) are then
    compared with all nodes.
    """
    no = F.lit(False)

    def forest(tiles: DataFrame, large: bool) -> DataFrame:
        return written(spark, _by_tile(payload(tiles, large), lambda tile: _forest(tile, threshold, exact)), "links")

    def some(times: str) -> "F.Column":
        return F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1))

    small = members.where("t = 1").select("g", F.lit(-1).alias("i"), F.lit(0).alias("j"), no.alias("left"), no.alias("covered"), "node")
    found = [forest(small, False)]
    big = members.where("t > 1")
    if not big.isEmpty():
        spokes = _dealt(big, "g", "t").select("g", F.col("chunk").alias("i"), F.lit(0).alias("j"), no.alias("left"), no.alias("covered"), "node")
        hubs = big.where("node = first").select("g", "node", some("t").alias("i")).select("g", "i", F.lit(0).alias("j"), F.lit(True).alias("left"), no.alias("covered"), "node")
        found.append(forest(spokes.unionByName(hubs), True))
        like = found[-1].select("g", F.col("b").alias("node"), F.lit(True).alias("like"))
        big = written(spark, big.join(like, ["g", "node"], "left").withColumn("covered", F.coalesce("like", F.col("node") == F.col("first"))).drop("like"), "big")
        share = big.where("not covered").groupBy("g", "n", "t").agg(F.count("*").alias("m"))
        share = written(spark, share.select("g", "n", F.least("t", F.ceil(F.col("m") * F.col("t") / F.col("n"))).alias("r")), "rest")
        if not share.isEmpty():
            every = with_keyed(big.drop("n"), share, ["g"], "n", big.count())
            left = _dealt(every.where("not covered"), "g", "r").select("g", F.col("chunk").alias("i"), some("t").alias("j"), F.lit(True).alias("left"), "covered", "node")
            right = _dealt(every, "g", "t").select("g", some("r").alias("i"), F.col("chunk").alias("j"), no.alias("left"), "covered", "node")
            found.append(forest(left.unionByName(right), True))
    return reduce(DataFrame.unionByName, found).select("a", "b")


def _found(spark: SparkSession, docs: DataFrame, threshold: float, key: str, text: str) -> tuple[DataFrame, bool]:
    """(doc, digest, n_shingles, first, first_digest) for each row, and whether all ids differ and none is null.

    first is the id of the class's first document, first_digest tells its text
    from others with that id (0 where all ids differ).
    """
    every = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    unique = every.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").isEmpty()
    every = every.select("doc", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("digest"), "text")
    row = ["doc"] if unique else ["doc", "digest"]
    base = written(spark, sketches(every), "sketches")
    # Rows of equal id and text are one from here on, until the result.
    one = base if unique else written(spark, base.dropDuplicates(row), "distinct")
    sets = one.where("n_shingles > 0").groupBy("k1", "k2")
    if unique:
        same = sets.agg(F.min("doc").alias("node"), F.count("*").alias("copies"))
        same = written(spark, same.select("k1", "k2", "node", "copies"), "classes")
    else:
        same = sets.agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "digest")).alias("least")).select("k1", "k2", "least.*")
        same = dense_id(same, ["none", "doc", "digest", "k1", "k2"], "node").drop("none")
    first = one.join(same.select(F.col("node").alias("doc")), "doc").withColumnRenamed("doc", "node") if unique else only(one, same, row).join(same.select("k1", "k2", "node"), ["k1", "k2"])
    reps = written(spark, first.select("node", "bytes", "sig", "bands"), "reps")
    rows = reps.select("node", F.explode("bands").alias("g"))
    buckets = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    buckets = written(spark, buckets.withColumn("t", F.ceil(F.col("n") / TILE)), "buckets")
    members = written(spark, with_keyed(rows, buckets, ["g"], "n", BANDS * reps.count()), "members")
    sigs = written(spark, only(reps, written(spark, members.select("node").distinct(), "nodes"), ["node"]).select("node", "sig"), "sigs")
    near = _similar(spark, members, lambda tiles, large: tiles.join(sigs, "node"), threshold, False)
    # The groups' documents, with whole texts, are verified tile by tile.
    group = linked(near).select("node", F.col("label").alias("g"))
    heavy = only(reps, group.select("node"), ["node"]).select("node", "bytes").join(group, "node")
    sizes = heavy.groupBy("g").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.sum("bytes").alias("bytes"))
    sizes = written(spark, sizes.select("g", "n", "first", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).alias("t")), "sizes")
    members = written(spark, with_keyed(group, sizes, ["g"], "n", group.count()), "members")
    ids = members.select("node", (F.col("t") > 1).alias("large"))
    if unique:
        ids = ids.withColumnRenamed("node", "doc")
        whole = every.join(F.broadcast(ids) if group.count() <= BROADCAST_IDS else ids, "doc").withColumnRenamed("doc", "node")
    else:
        wanted = written(spark, ids.join(same, "node").select("node", "large", F.col("doc").alias("d"), "digest"), "wanted")
        whole = only(every, wanted.withColumnRenamed("d", "doc"), row).groupBy("doc", "digest").agg(F.min("text").alias("text"))
        whole = whole.join(wanted, whole.doc.eqNullSafe(wanted.d) & (whole.digest == wanted.digest))
    texts = written(spark, whole.select("node", "large", "text"), "texts")

    def with_texts(tiles: DataFrame, large: bool) -> DataFrame:
        return tiles.join(sigs, "node").join(texts.where("large" if large else "not large").drop("large"), "node")

    label = linked(_similar(spark, members, with_texts, threshold, True))
    # Back to all rows: class by set, first document by component.
    label = same.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if unique:
        label = label.select("k1", "k2", "copies", F.col("label").alias("first"), F.lit(0).cast("long").alias("first_digest"))
    else:
        members = label.groupBy("label").agg(F.count("*").alias("members")).join(same.select(F.col("node").alias("label"), F.col("doc").alias("first"), F.col("digest").alias("first_digest")), "label")
        members = written(spark, members, "firsts")
        copies = base.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
        label = with_keyed(label.select("k1", "k2", "label"), members, ["label"], "members", same.count()).join(copies, ["k1", "k2"]).select("k1", "k2", "copies", "first", "first_digest")
    label = written(spark, label, "labels")
    full = base.where("n_shingles > 0").select("doc", "digest", "n_shingles", "k1", "k2")
    full = with_keyed(full, label, ["k1", "k2"], "copies", base.count()).select("doc", "digest", "n_shingles", "first", "first_digest")
    bare = base.where("n_shingles = 0").select("doc", "digest", "n_shingles", F.col("doc").alias("first"), F.col("digest").alias("first_digest"))
    return full.unionByName(bare), unique


def classes(spark: SparkSession, docs: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    found, _ = _found(spark, docs, threshold, key, text)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"), F.col("doc").eqNullSafe(F.col("first")).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, all columns as they are: its first document, and of rows that repeat its id and text the least by all columns."""
    found, unique = _found(spark, docs, threshold, key, text)
    found = written(spark, found, "found")
    gone = found.where(~(F.col("doc").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("first_digest")))).select("doc", "digest").distinct()
    gone = written(spark, gone, "gone")
    if unique:
        return only(docs, gone.select(F.col("doc").alias(key)), [key], "left_anti")
    doc, digest = own_names(["doc", "digest"], docs.columns)
    marked = docs.withColumns({doc: F.col(key).cast("long"), digest: F.xxhash64(F.col(text).cast("string"))})
    twice = found.where("n_shingles > 0").groupBy("doc", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias(doc), F.col("digest").alias(digest))
    twice = written(spark, twice, "twice")
    kept = only(marked, gone.select(F.col("doc").alias(doc), F.col("digest").alias(digest)), [doc, digest], "left_anti")
    least = F.min_by(F.struct(*docs.columns), F.struct(*[c for c in docs.columns if orderable(docs.schema[c].dataType)])).alias("row")
    once = only(kept, twice, [doc, digest]).groupBy(doc, digest).agg(least).select("row.*")
    return only(kept, twice, [doc, digest], "left_anti").select(*docs.columns).unionByName(once)


def orderable(of: DataType) -> bool:
    """Whether Spark can sort by a type: maps (and variants) have no order, nor has what holds one."""
    return not any(word in of.simpleString() for word in ("map<", "variant"))
