"""Filter interaction audit by Walsh-Hadamard sums.

Each row fails some of k filters: a mask of k bits. For every part and label
class the 2^k signed parity sums W[S] = sum of (-1)^|mask & S| are aggregated,
nothing else leaves the scan; the transform is its own inverse up to 2^k, so
cell[m] = sum of (-1)^|m & S| W[S] / 2^k is exact in whole numbers. From the
cells come the rows that pass every set of filters, and from those each step
of each of the k! orders. A row with c failing filters is removed by each of
them in k! / c orders, which gives the Shapley sums in closed form.

Rows first meet by (text digest, id, part, mask), with their number, so that a
repeated row is one row from there on; the smallest id of a text comes from an
aggregate, and rows meet it by (digest, id), which no copy group makes hot.

Defined results: null text is empty, null part the empty string; a null id is
neither smaller nor larger than another and has no label; an id with several
label rows has a label if any of them says so; repeated rows count each, and
of equal texts those with the smallest id are the first ones; an empty table
gives no rows; columns beside the named ones are not read. Texts of any length
are read by column functions alone.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^k sums and k! orders: 64 and 720.
MOST_FILTERS = 6
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows without an id are dealt over so many keys in the join with labels.
SALTS = 1024


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that depend on a text alone: few words, repeated words, capitals, special characters."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, key: str, text: str, part: str) -> tuple[DataFrame, list[str]]:
    """(id, part, mask, n): how many rows fail which filters, bit by bit in the order of the returned names; the last one, E, fails where a smaller id has the identical text."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    failing = text_failures(F.col("text"))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(failing.values())), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    later = (F.col("first").isNull() & F.col("id").isNotNull()).cast("int") * (1 << len(failing))
    return rows.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + later).alias("mask"), "n"), [*failing, "E"]


def labelled(rows: DataFrame, labels: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """rows (id, part, mask, n) with a boolean column for each mark: a label row of the id has 1 there."""
    own = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.max(F.coalesce(F.col(m) == 1, F.lit(False))).alias(m) for m in marks])
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("part", "mask", "n"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("long")
    joined = rows.withColumn("salt", salt).join(own.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(m, F.lit(False)).alias(m) for m in marks])


def walsh_sums(rows: DataFrame, k: int, marks: list[str]) -> DataFrame:
    """(part, marks..., sums): the 2^k signed parity sums of each part and label class."""
    sign = lambda s: 1 - 2 * F.pmod(F.bit_count(F.col("mask").bitwiseAND(s)), F.lit(2))
    return rows.groupBy("part", *marks).agg(F.array(*[F.sum(sign(s) * F.col("n")) for s in range(1 << k)]).alias("sums"))


def cells(sums: DataFrame, k: int, marks: list[str]) -> DataFrame:
    """(part, all, one array for each mark): the rows of each mask, in all and within each label, by the exact inverse."""
    size = 1 << k
    back = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.aggregate(F.transform("sums", lambda w, s: w * (1 - 2 * F.pmod(F.bit_count(m.bitwiseAND(s)), F.lit(2)))), F.lit(0).cast("long"), lambda a, x: a + x))
    own = sums.select("part", *marks, F.transform(back, lambda c: (c / size).cast("long")).alias("cell"))
    added = lambda when: F.array(*[F.sum(F.when(when, F.col("cell")[m]).otherwise(0)) for m in range(size)])
    return own.groupBy("part").agg(added(F.lit(True)).alias("all"), *[added(F.col(m)).alias(m) for m in marks])


def orders(cells: DataFrame, names: list[str], lost: dict[str, str]) -> DataFrame:
    """One row for each part, order and step; `lost` names a column of removed rows for each label array."""
    k = len(names)
    if k > MOST_FILTERS:
        raise ValueError(f"{k} filters have {math.factorial(k)} orders; at most {MOST_FILTERS} are taken")
    size = 1 << k
    index = F.sequence(F.lit(0), F.lit(size - 1))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    passing = lambda of: F.transform(index, lambda p: total(F.filter(F.col(of), lambda _, m: m.bitwiseAND(p) == 0)))

    def shares(f: int) -> Column:
        of = lambda c, m: F.when(m.bitwiseAND(1 << f) != 0, c * F.floor(F.lit(math.factorial(k)) / F.bit_count(m))).otherwise(F.lit(0).cast("long"))
        return total(F.transform("all", of))

    shapley = F.array(*[shares(f) for f in range(k)])
    wide = cells.select("part", "all", shapley.alias("shapley"), passing("all").alias("pass"), *[passing(m).alias(f"pass_{m}") for m in lost])
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[x] for x in order), "step": step, "f": f, "bit": 1 << f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, f: int, bit: int, before: int, after: int>>")
    each = wide.select("*", F.inline(plan))
    at = lambda of, where: F.get(F.col(of), where)
    removed = at("pass", F.col("before")) - at("pass", F.col("after"))
    return each.select(
        "part",
        "filter_order",
        "step",
        at("pass", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (at("pass", F.lit(0)) - at("pass", F.col("bit")) - removed).alias("redundant"),
        at("all", F.col("bit")).alias("unique_fails"),
        *[(at(f"pass_{m}", F.col("before")) - at(f"pass_{m}", F.col("after"))).alias(name) for m, name in lost.items()],
        at("shapley", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, lost: dict[str, str], key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a count of removed rows for each label, shapley.

    `lost` maps a column of `labels` to the name of its count.
    """
    rows, names = masked(docs, key, text, part)
    marks = list(lost)
    sums = walsh_sums(labelled(rows, labels, key, marks), len(names), marks)
    return orders(cells(sums, len(names), marks), names, lost)
