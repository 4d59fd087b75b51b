"""Chat formatting of reply trees, with DataFrame functions only.

Messages name their parent. Root-to-leaf paths are enumerated by iterative
self-joins that double their reach: after k rounds each message knows its
2^k-th ancestor and the scores of its nearest 2^k messages, so a thread of n
messages takes about log2(n) rounds on id columns alone. Branches are ranked
by the sum of their messages' scores; only then are the chosen leaves' paths
enumerated, and each becomes one conversation in a ChatML-like template.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles
and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line
feed also becomes ``<\\/``), so no control string can arise and the escape can
be undone exactly.

Defined results: null text or role is empty; a null score is 0; a message whose
parent is null or absent is a root; messages in a cycle of parents, or that
hang off one, have no root and belong to no path, and neither do messages
without an id; equal branch scores go to the smaller leaf id; a null tree id
is a tree of its own; rows that repeat a message id in a tree are one message,
the least by parent, role, text and score (linear_tree numbers rows, so there
each is a message of its own); columns beside the named ones are not read. A
very long conversation is one row, so a task holds a few copies of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.common import written
from kinloom.scratch import dropped

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def linear_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of conversations as reply trees of one branch: each row replies to the one before it, by turn, then role, then text."""
    rows = rows.select(F.col(conv).alias("tree_id"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("tree_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree_id", number.alias("msg_id"), F.when(number > 1, number - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def ancestors(spark: SparkSession, ids: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables k = 0, 1, ... of (t, m, to, s): message m's 2^k-th ancestor, and the scores of m and those between; and those (t, m) whose ancestors never end.

    A tree that has a message of depth d has one of every smaller depth, so
    once a round ends for no message, those left run into a cycle.
    """
    known = ids.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"))
    jump = written(spark, ids.join(known, ids.tree_id.eqNullSafe(known.t) & (ids.parent_id == known.m)).select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), F.col("parent_id").alias("to"), F.col("score").alias("s")), "jump")
    tables, left = [], None
    while (now := jump.count()) and now != left:
        tables.append(jump)
        left = now
        hop = jump.select(F.col("t").alias("t2"), F.col("m").alias("m2"), F.col("to").alias("far"), F.col("s").alias("s2"))
        jump = written(spark, jump.join(hop, jump.t.eqNullSafe(hop.t2) & (jump["to"] == hop.m2)).select("t", "m", F.col("far").alias("to"), (F.col("s") + F.col("s2")).alias("s")), "jump")
    return tables, jump.select("t", "m")


def branch_scores(spark: SparkSession, leaves: DataFrame, ids: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree_id, leaf_id, total): the scores of each leaf and all its ancestors; a leaf climbs by the longest reach first, which takes each power of two at most once."""
    at = written(spark, leaves.select("tree_id", "leaf_id", F.col("leaf_id").alias("msg_id"), F.lit(0.0).alias("total")), "climb")
    for jump in reversed(tables):
        old, climbed = at, at.join(jump, at.tree_id.eqNullSafe(jump.t) & (at.msg_id == jump.m), "left")
        at = written(spark, climbed.select("tree_id", "leaf_id", F.coalesce("to", "msg_id").alias("msg_id"), (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("total")), "climb")
        dropped(old)
    root = ids.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "score")
    return at.join(root, at.tree_id.eqNullSafe(root.t) & (at.msg_id == root.m)).select("tree_id", "leaf_id", (F.col("total") + F.col("score")).alias("total"))


def paths(spark: SparkSession, messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, branch_rank, msg_id, up): the messages of each tree's `branches` best root-to-leaf paths (all by default), `up` steps above the leaf; one row for each message id of a tree.

    Leaves are ranked by their path's score before any path is enumerated, so
    there are only rows of chosen paths.
    """
    ids = written(spark, messages.select("tree_id", "msg_id", "parent_id", "score"), "messages")
    tables, endless = ancestors(spark, ids)
    same = lambda c: c.tree_id.eqNullSafe(F.col("t")) & (c.msg_id == F.col("m"))
    parents = tables[0].select("t", F.col("to").alias("m")).distinct() if tables else endless
    leaves = ids.where("msg_id is not null").join(parents, same(ids), "left_anti").join(endless, same(ids), "left_anti").select("tree_id", F.col("msg_id").alias("leaf_id"))
    scored = branch_scores(spark, leaves, ids, tables)
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("total"), "leaf_id"))
    reach = scored.withColumn("branch_rank", place).where(F.lit(True) if branches is None else F.col("branch_rank") <= branches)
    reach = written(spark, reach.select("tree_id", "leaf_id", "branch_rank", F.col("leaf_id").alias("msg_id"), F.lit(0).cast("long").alias("up")), "reach")
    for k, jump in enumerate(tables):
        further = reach.join(jump, same(reach)).select("tree_id", "leaf_id", "branch_rank", F.col("to").alias("msg_id"), (F.col("up") + (1 << k)).alias("up"))
        old, reach = reach, written(spark, reach.unionByName(further), "reach")
        dropped(old)
    dropped(ids, *tables)
    return reach


def one_each(messages: DataFrame) -> DataFrame:
    """One row for each message id of a tree, the least by its other columns; as it is where no id repeats."""
    key = ["tree_id", "msg_id"]
    if messages.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return messages
    rest = F.min(F.struct("parent_id", "role", "text", "score")).alias("least")
    return messages.groupBy(*key).agg(rest).select(*key, "least.*")


def conversations(spark: SparkSession, messages: DataFrame, branches: int = 1) -> DataFrame:
    """The `branches` best paths of each tree, formatted.

    messages: tree_id, msg_id, parent_id, role, text, score. Returns tree_id,
    leaf_id, branch_rank, formatted and loss_spans (array of start, length in
    code points of formatted: the escaped text of each assistant turn).
    """
    messages = written(spark, messages.select("tree_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), "turns")
    messages = one_each(messages)
    on_path = paths(spark, messages, branches)
    picked = on_path.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "leaf_id", "branch_rank", "up")
    turns = messages.join(picked, messages.tree_id.eqNullSafe(F.col("t")) & (messages.msg_id == F.col("m"))).select("tree_id", "leaf_id", "branch_rank", "up", (F.col("role") == "assistant").alias("target"), F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("head") + F.length("body") + len(END)
    turns = turns.withColumn("end", F.sum(size.cast("long")).over(order))
    span = F.when(F.col("target"), F.struct((F.col("end") - len(END) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length")))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    return (
        turns.groupBy("tree_id", "leaf_id", "branch_rank")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select("tree_id", "leaf_id", "branch_rank", F.concat_ws("", F.col("turns.piece")).alias("formatted"), F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"))
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        cut = F.locate("\n", piece)
        return F.struct(unescape_role(F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"), unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    back = chats.select(F.col("tree_id").alias("conv_id"), "formatted", parsed(F.col("formatted")).alias("turns"), F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))).alias("loss"))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
