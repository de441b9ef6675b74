"""Chat formatting of reply trees, with DataFrame functions only.

Turns are nodes with a parent. Neighbouring nodes that are only replies make one segment, so a chain of any length is a
tree of one node. Pointer doubling, a self-join a round, sums the scores of every path to the root; the leaves of a
conversation are ranked by the mean score of their path's turns, and the chosen leaves' paths are enumerated by the same
doubling: a round joins what a path holds so far with the ancestors 1, 2, 4, ... steps further up. So the number of joins grows
with the logarithm of the segments of the longest path. The structure is found without texts, which are shuffled once.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash is doubled, and one is
put behind each ``<`` and ``[``, which breaks every control string that begins with one (``</s>``, ``[INST]``, ``<|...``);
reading back removes exactly those. The loss mask lists the places of the texts of the trained role.

Defined results: null roles and texts count as empty; rows without a conv_id are one conversation; turns that tie on their
number are ordered by role and MD5 of the text; a parent that doesn't exist makes a root; turns on a cycle belong to no
conversation; branches that tie are ordered by length, the longest first, then by the smaller leaf; a null score counts 0; a
node number stands for one row of its conversation; further columns are not read. A formatted conversation is one row, so
the longest must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"[<\[]", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


#: A conversation's key without nulls: joins and windows on it share one shuffle.
KEY = ("conv", "nameless")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("nameless"), *(c for c in df.columns if c != "conv_id"))


def chains(turns: DataFrame) -> DataFrame:
    """Nodes of conversations without replies' parents: each turn answers the one before it."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(text).alias("digest"), text.alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "digest")).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def segments(nodes: DataFrame) -> DataFrame:
    """(conv, nameless, node, parent, first, steps, total): runs of neighbouring nodes, each the only reply to the one before,
    named by their last node; ``first`` is the place of the first among the conversation's nodes, from 1."""
    rows = _keyed(nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    siblings = F.count(F.lit(1)).over(W.partitionBy(*KEY, "parent"))
    order = W.partitionBy(*KEY).orderBy("node")
    begins = F.col("parent").isNull() | (F.col("siblings") > 1) | ~F.col("parent").eqNullSafe(F.lag("node").over(order))
    placed = rows.withColumn("siblings", siblings).withColumn("begins", begins).withColumn("at", F.row_number().over(order)).withColumn("segment", F.sum(F.col("begins").cast("int")).over(order))
    return placed.groupBy(*KEY, "segment").agg(F.max("node").alias("node"), F.min_by("parent", "at").alias("parent"), F.min("at").alias("first"), F.count(F.lit(1)).alias("steps"), F.sum("score").alias("total")).drop("segment")


def paths(nodes: DataFrame, space: Workspace, branches: int = 1) -> DataFrame:
    """(conv, nameless, branch, ranges): each conversation's ``branches`` best root-to-leaf paths, from the root, as ranges
    of places (first, last) among its nodes and the number of nodes before them (before)."""
    key = [*KEY, "node"]
    runs = space.keep(segments(nodes), "segments")
    parents = runs.select(*KEY, F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = runs.join(parents, [*KEY, "parent"], "left")
    jump = space.keep(linked.select(*key, F.when(F.col("known"), F.col("parent")).alias("above"), "total", "steps"), "jump0")
    open_, done, jumps = jump.where(F.col("above").isNotNull()), jump.where(F.col("above").isNull()), []
    most = runs.groupBy(*KEY).count().agg(F.max("count")).first()[0] or 0
    answered = open_.select(*KEY, F.col("above").alias("node")).distinct()
    # only paths that haven't reached their root are joined on
    while 1 << len(jumps) <= most and not open_.isEmpty():
        jumps.append(open_.select(*key, "above"))
        far = open_.union(done).select(*KEY, F.col("node").alias("above"), F.col("above").alias("above2"), F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        on = open_.join(far, [*KEY, "above"])
        jump = space.keep(on.select(*key, F.col("above2").alias("above"), (F.col("total") + F.col("total2")).alias("total"), (F.col("steps") + F.col("steps2")).alias("steps")), f"jump{len(jumps)}")
        open_, done = jump.where(F.col("above").isNotNull()), done.union(jump.where(F.col("above").isNull()))
    leaves = done.join(answered, key, "left_anti")
    rank = F.struct((-F.col("total") / F.col("steps")).alias("a"), (-F.col("steps")).alias("b"), F.col("node").alias("c"))
    if branches == 1:
        chosen = leaves.groupBy(*KEY).agg(F.min(rank).alias("r")).select(*KEY, F.col("r.c").alias("leaf"), F.lit(1).alias("branch"))
    else:
        chosen = leaves.withColumn("branch", F.row_number().over(W.partitionBy(*KEY).orderBy(rank))).where(F.col("branch") <= branches).select(*KEY, F.col("node").alias("leaf"), "branch")
    held = chosen.select(*KEY, "branch", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, step in enumerate(jumps):
        held = space.keep(held, f"path{k}")
        held = held.union(held.join(step, key).select(*KEY, "branch", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up")))
    above = W.partitionBy(*KEY, "branch").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    parts = held.join(runs, key).withColumn("before", F.coalesce(F.sum("steps").over(above), F.lit(0)))
    one = F.struct("before", "first", (F.col("first") + F.col("steps") - 1).alias("last"))
    return space.keep(parts.groupBy(*KEY, "branch").agg(F.array_sort(F.collect_list(one)).alias("ranges")), "chosen")


def format_trees(nodes: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """(conv_id, branch, formatted, loss): the text of each chosen path and the places (start and end, in code points)
    under the loss mask."""
    space = Workspace(nodes.sparkSession, "chat")
    chosen = paths(nodes, space, branches)
    texts = _keyed(nodes.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    placed = texts.withColumn("at", F.row_number().over(W.partitionBy(*KEY).orderBy("node")))
    inside = F.get(F.filter("ranges", lambda r: F.col("at").between(r["first"], r["last"])), F.lit(0))
    # the join keeps the partitions of the window, so that texts are shuffled once
    turn = placed.join(chosen.hint("merge"), list(KEY)).withColumn("range", inside).where(F.col("range").isNotNull())
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    parts = turn.select(*KEY, "branch", (F.col("range.before") + F.col("at") - F.col("range.first")).alias("nth"), "role", F.char_length(head).alias("head"), F.char_length(text).alias("body"), F.concat(head, text, F.lit(END)).alias("piece"))
    before = W.partitionBy(*KEY, "branch").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.col("head")
    spans = parts.select(*KEY, "branch", "nth", "piece", F.when(F.col("role") == trained, F.struct(start.cast("long").alias("start"), (start + F.col("body")).cast("long").alias("end"))).alias("span"))
    whole = spans.groupBy(*KEY, "branch").agg(F.array_sort(F.collect_list(F.struct("nth", "piece", "span"))).alias("turns"))
    return whole.select(F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "branch", F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``trained`` (texts under the loss mask), unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)

    def parse(piece: Column) -> Column:
        two = F.split(piece, r"<\|text\|>", 2)
        text = two[1]
        return F.struct(unescape(two[0]).alias("role"), unescape(F.left(text, F.char_length(text) - len(END))).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, parse)).withColumn("trained", under)


def digests(nodes: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    back = read_back(format_trees(nodes))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
