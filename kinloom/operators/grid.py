"""Work on pairs of rows, dealt as a grid of cells.

Rows are cut into strips; a cell meets one strip of either side and is one
task. A row goes to each cell of its strip, so what is shuffled grows with the
rows times the sides of the grid (about the square root of the tasks), not
with the number of pairs. In a task the left strip (STRIP_BYTES at most) is
held, the right one streams past it in tiles, and results are yielded tile by
tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, of which two meet at once.
TILE = 256
#: Bytes of vectors that a task holds of its left strip.
STRIP_BYTES = 64 << 20


class Cell:
    """What a task does in one cell: it sees all of the left strip, then all of the right one, both in order."""

    def __init__(self, number: int):
        self.number = number

    def left(self, rows: pa.RecordBatch) -> None: ...

    def right(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def over_cells(rows: DataFrame, cells: int, order: list[str], cell: Callable[[int], Cell], schema: str, tile: int | None = None) -> DataFrame:
    """Rows with columns _cell (0 ... cells - 1) and _side (0 or 1) go to their cell's task, sorted by side and order, and come to it in tiles."""
    tile = tile or TILE

    def run(batches):
        state = None
        for batch in batches:
            numbers, sides = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_cell", "_side"))
            cuts = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(numbers)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if state is None or state.number != numbers[s]:
                    if state is not None:
                        yield from state.end()
                    state = cell(int(numbers[s]))
                for at in range(s, e, tile):
                    part = batch.slice(at, min(tile, e - at))
                    if sides[s]:
                        yield from state.right(part)
                    else:
                        state.left(part)
        if state is not None:
            yield from state.end()

    return rows.repartitionById(cells, F.col("_cell")).sortWithinPartitions("_cell", "_side", *order).mapInArrow(run, schema)


def tasks_of(rows: DataFrame) -> int:
    return 2 * rows.sparkSession.sparkContext.defaultParallelism


def strips(n: int, row_bytes: int, tasks: int) -> int:
    """Sides of a triangular grid: enough for memory and for the tasks, but no strip under a tile."""
    return max(1, math.ceil(n * row_bytes / STRIP_BYTES), min(math.ceil(n / TILE), math.ceil((math.sqrt(8 * tasks + 1) - 1) / 2)))


class _Triangle(Cell):
    def __init__(self, number: int, prepare: Callable, pair: Callable):
        super().__init__(number)
        b = (math.isqrt(8 * number + 1) - 1) // 2
        self.diagonal = number == b * (b + 1) // 2 + b
        self.prepare, self.pair, self.held, self.seen, self.passed = prepare, pair, [], 0, 0

    def left(self, rows):
        self.held.append((self.seen, len(rows), self.prepare(rows)))
        self.seen += len(rows)

    def right(self, rows):
        own = self.prepare(rows)
        for at, n, other in self.held:
            if not self.diagonal:
                out = self.pair(other, own, np.ones((n, len(rows)), bool))
            elif at < self.passed + len(rows) - 1:
                out = self.pair(other, own, (at + np.arange(n))[:, None] < (self.passed + np.arange(len(rows)))[None, :])
            else:
                break
            if out.num_rows:
                yield out
        self.passed += len(rows)


def triangle(rows: DataFrame, strip: Column, sides: int, order: list[str], prepare: Callable[[pa.RecordBatch], object], pair: Callable[[object, object, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Every pair of different rows once: pair(left tile, right tile, mask of pairs) makes the result rows.

    strip is 0 ... sides - 1 and rises with `order`, if the left row of a pair
    is to be the earlier one; order must tell rows apart.
    """
    return triangle_cells(rows, strip, sides, order, lambda n: _Triangle(n, prepare, pair), schema)


def triangle_cells(rows: DataFrame, strip: Column, sides: int, order: list[str], cell: Callable[[int], Cell], schema: str) -> DataFrame:
    """As triangle, with a cell of one's own: cell b * (b + 1) / 2 + a meets strips a <= b."""
    number = lambda a, b: F.shiftright(b * (b + 1), 1) + a
    s = F.col("_strip")
    lefts = F.transform(F.sequence(s, F.lit(sides - 1)), lambda b: F.struct(number(s, b).alias("_cell"), F.lit(0).alias("_side")))
    rights = F.transform(F.sequence(F.lit(0), s), lambda a: F.struct(number(a, s).alias("_cell"), F.lit(1).alias("_side")))
    copies = rows.withColumn("_strip", strip.cast("int")).withColumn("_to", F.explode(F.concat(lefts, rights)))
    copies = copies.select("_to._cell", "_to._side", *rows.columns)
    return over_cells(copies, sides * (sides + 1) // 2, order, cell, schema)


def rectangle(left: DataFrame, right: DataFrame, left_strip: Column, right_strip: Column, sides: tuple[int, int], order: list[str], cell: Callable[[int], Cell], schema: str, tile: int | None = None) -> DataFrame:
    """Every row of left meets every row of right (same columns): cell(number) works on one strip of either side."""
    a, b = sides
    lefts = left.withColumn("_strip", left_strip.cast("int")).withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda t: F.col("_strip") * b + t)))
    rights = right.withColumn("_strip", right_strip.cast("int")).withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(a - 1)), lambda t: t * b + F.col("_strip"))))
    both = lefts.select("_cell", F.lit(0).alias("_side"), *left.columns).unionByName(rights.select("_cell", F.lit(1).alias("_side"), *left.columns))
    return over_cells(both, a * b, order, cell, schema, tile)
