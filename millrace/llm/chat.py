"""Chat formatting of reply trees, with DataFrame functions only.

A tree is rows (tree, node, parent, role, text, score). Iterative self-joins with doubled jumps give every
node its root and the score of its path in a number of rounds that is the logarithm of the depth; leaves are
ranked by their path's score; for the chosen leaves the same jump tables enumerate the nodes from root to
leaf, and each path becomes one conversation.

The template writes ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline per turn. In
roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``, in roles a newline becomes ``<|nl|>``; so no
text can hold a control string and :func:`unescape` gives the text back. ``loss`` holds (start, length) of
the escaped assistant texts in code points, without their control strings.

Defined cases: null roles and texts are empty; a node whose parent is missing or null is a root; of rows that
repeat a tree's node the smallest by (parent, role, text, score) holds; nodes on a cycle, or answering one, reach
no root and are in no path; equal scores rank by the smaller leaf; children of the same parent stay separate
branches; a null tree is a tree; texts of any length are formatted whole; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """Roles also hold no newline; no escaped text holds ``<|``, so its stand-in is unambiguous."""
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def _nodes(nodes: DataFrame) -> DataFrame:
    """One row per node of a tree."""
    rest = F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    return nodes.where("node is not null").groupBy("tree", "node").agg(F.min(rest).alias("x")).select("tree", "node", "x.*")


def tree_paths(spark: SparkSession, nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, depth, node): nodes of the ``best`` paths of each tree, ``depth`` from 0 at the root.

    ``nodes`` has tree, node, parent (node numbers within the tree), role, text and score; all paths if ``best`` is None.
    """
    scratch = Scratch(spark, "chat")
    return _paths(scratch, scratch.put(_nodes(nodes), "nodes"), best)


def _paths(scratch: Scratch, own: DataFrame, best: int | None) -> DataFrame:
    known = own.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    base = own.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up"), "score")
    # jump tables: level i leads 2**i nodes towards the root; null above it
    state = scratch.put(base.select("tree", "node", "up", F.col("score").alias("gain"), F.lit(1).cast("long").alias("steps")), "jump0")
    levels = [state]
    # no path is longer than the largest tree has nodes: what still leads upwards after so many rounds is on a cycle or below one
    most = own.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log2(most)) + 1)):
        if not state.where("up is not null").limit(1).count():
            break
        far = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("gain").alias("gain2"), F.col("steps").alias("steps2"))
        state = state.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")), "left").select(
            "tree", "node", F.col("up2").alias("up"), (F.col("gain") + F.coalesce("gain2", F.lit(0.0))).alias("gain"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")
        )
        state = scratch.put(state, "jump")
        levels.append(state)
    state = state.where("up is null")
    parents = levels[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = state.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), F.col("gain").alias("path_score"), (F.col("steps") - 1).alias("last"))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    paths = scratch.put(leaves.select("*", F.col("leaf").alias("node"), F.col("last").alias("depth")), "leaves")
    for i, jump in enumerate(levels[:-1]):
        j = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = paths.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(*[c for c in paths.columns if c not in ("node", "depth")], F.col("up").alias("node"), (F.col("depth") - (1 << i)).alias("depth"))
        paths = scratch.put(paths.unionByName(more), "paths")
    return paths.select("tree", "leaf", "rank", "path_score", "depth", "node")


def format_conversations(spark: SparkSession, nodes: DataFrame, best: int | None = None, trained: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, path_score, formatted, loss): one row per chosen path."""
    scratch = Scratch(spark, "chat")
    nodes = scratch.put(_nodes(nodes), "nodes")
    paths = _paths(scratch, nodes, best)
    said = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("x"), (F.coalesce("role", F.lit("")) == trained).alias("m"))
    rows = paths.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turns = rows.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(F.struct("depth", "r", "x", "m"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["r"], F.lit("\n"))
    whole = lambda t: F.concat(head(t), t["x"], F.lit(END + "\n"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    mask = F.aggregate(
        "turns",
        zero,
        lambda a, t: F.struct(
            (a["at"] + F.char_length(whole(t))).alias("at"),
            F.when(t["m"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(head(t))).cast("long").alias("start"), F.char_length(t["x"]).cast("long").alias("length")))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return turns.select("tree", "leaf", "rank", "path_score", F.array_join(F.transform("turns", whole), "").alias("formatted"), mask.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)
    tail = len(END) + 1

    def turn(p):
        at = F.instr(p, "\n")
        body = p.substr(at + 1, F.char_length(p) - at - tail)
        return F.struct(unescape_role(p.substr(F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between its parts."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_trees(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as trees of one branch: each row answers the row before it; ties of a turn go by role and text."""
    order = Window.partitionBy(F.col(conv)).orderBy(F.col(turn).asc_nulls_last(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    n = F.row_number().over(order).cast("long")
    return df.select(F.col(conv).cast("long").alias("tree"), n.alias("node"), F.col(role).alias("role"), F.col(text).alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
