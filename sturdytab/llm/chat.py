"""Chat formatting of reply trees: paths by iterative self-joins, ranked branches, one formatted text a chosen path.

A message names its tree, itself and its parent (null, or absent from the tree: a root). Ancestors are found by
doubling: round r joins the messages with themselves on the ancestor 2^r steps up and adds path lengths and scores, so
a path of n turns takes log2(n) rounds; messages that have reached their root leave the rounds. A leaf's path has the mean score of its messages (null: 0); the `best` highest
paths of a tree are formatted, ties to the smaller leaf.

Template: `<|im_start|>role<|im_sep|>text<|im_end|>` and a line feed per turn. Inside roles and texts a backslash is
doubled and each control string gets a backslash after its first character, so a text can neither open nor close a
turn and `unescaped` gives it back exactly. Loss spans (start, length, in code points) cover the escaped texts of the
assistant's turns and nothing else.

A null text or role is empty. A null tree is a tree of its own. Rows that repeat a message's key count once (the
smallest role, then text). Messages on a cycle have no root and no leaf below one; they are left out. Empty tables give
an empty result. All work is DataFrame expressions; a conversation's turns meet in one row, as its text is one value.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sturdytab.llm.common import need
from sturdytab.session import settle

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROLS = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROLS, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chosen_paths(messages: DataFrame, best: int) -> DataFrame:
    """(tree, leaf, score, node, depth from the leaf) of every message on a chosen path."""
    nodes = settle(messages.select("tree", "node", "parent", "score"), "nodes")
    up = nodes.select("tree", F.col("node").alias("above"))
    own = F.coalesce("score", F.lit(0.0))
    step = nodes.withColumnRenamed("tree", "t").join(
        up, F.col("t").eqNullSafe(F.col("tree")) & (F.col("parent") == F.col("above")), "left")
    step = settle(step.select(F.col("t").alias("tree"), "node", "above", F.lit(1).cast("long").alias("n"),
                              own.alias("total")), "jumps")
    leaves = nodes.select("tree", "node").join(
        nodes.where("parent is not null and parent <> node").select(F.col("tree").alias("t"), "parent"),
        F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("parent")), "left_anti")
    jumps, done, active = [], step.where("above is null"), step.where("above is not null")
    rounds = math.ceil(math.log2(max(2, nodes.count()))) + 1
    while len(jumps) <= rounds and active.limit(1).count():
        jumps.append(active.select("tree", "node", "above"))
        high = done.union(active).select(F.col("tree").alias("t"), F.col("node").alias("via"), F.col("above").alias("top"),
                                         F.col("n").alias("more"), F.col("total").alias("plus"))
        met = active.join(high, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("via")))
        met = settle(met.select("tree", "node", F.col("top").alias("above"), (F.col("n") + F.col("more")).alias("n"),
                                (F.col("total") + F.col("plus")).alias("total")), "jumps")
        done, active = done.union(met.where("above is null")), met.where("above is not null")
    rooted = done.withColumnRenamed("tree", "t").withColumnRenamed("node", "leaf")
    ends = leaves.join(rooted, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("leaf")))
    ranked = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ends = ends.select("tree", "leaf", (F.col("total") / F.col("n")).alias("score")).withColumn(
        "rank", F.row_number().over(ranked)).where(F.col("rank") <= best)
    paths = ends.select("tree", "leaf", "score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth"))
    for r, jump in enumerate(jumps):
        link = jump.select(F.col("tree").alias("t"), F.col("node").alias("via"), "above")
        more = paths.join(link, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("via")))
        more = more.select("tree", "leaf", "score", F.col("above").alias("node"), (F.col("depth") + 2**r).alias("depth"))
        paths = settle(paths.union(more), "paths")
    return paths


def format_trees(messages: DataFrame, tree_col: str, node_col: str, parent_col: str, role_col: str = "role",
                 text_col: str = "text", score_col: str | None = None, best: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, score, n_turns, formatted, loss_spans (array of start and length)."""
    need(messages, tree_col, node_col, parent_col, role_col, text_col, *([score_col] if score_col else []))
    score = F.col(score_col).cast("double") if score_col else F.lit(None).cast("double")
    rows = messages.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"),
                           F.col(parent_col).alias("parent"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("text"), score.alias("score"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select(
        "tree", "node", "m.parent", "m.role", "m.text", "m.score")
    rows = settle(rows.where("node is not null"), "messages")
    paths = chosen_paths(rows, best)
    said = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    turns = turns.select("tree", "leaf", "score", "depth", "role", head.alias("head"),
                         escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    held = turns.groupBy("tree", "leaf").agg(
        F.max("score").alias("score"), F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("order"), "turn", "role", "at",
                                             F.length("body").alias("length")))).alias("turns"))
    spoken = F.filter("turns", lambda t: t.role == "assistant")
    return held.select(
        F.col("tree").alias(tree_col), "leaf", "score", "n_turns",
        F.array_join(F.transform("turns", lambda t: t.turn), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["at"].alias("start"), t["length"].cast("long").alias("length")))
        .alias("loss_spans"))


def as_trees(turns: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """Plain conversations as reply trees without branches: node and parent number the rows by turn, then role and
    text, so rows of one turn all stay. Null turns come first."""
    need(turns, tree_col, turn_col, role_col, text_col)
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns.select(F.col(tree_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                        F.col(text_col).alias("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from the formatted text."""
    ended = F.split(formatted, rf"\Q{END}\E\n")
    return F.transform(F.slice(ended, 1, F.size(ended) - 1), lambda t: F.struct(
        unescaped(F.substring_index(F.substr(t, F.lit(len(START) + 1)), SEP, 1)).alias("role"),
        unescaped(F.substr(t, F.length(F.substring_index(t, SEP, 1)) + len(SEP) + 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substr(
        formatted, (s.start + 1).cast("int"), s.length.cast("int"))), ""))
