"""Chat formatting from reply trees.

Nodes (conv_id, node_id, parent_id, role, text, score) are linked to their parents.
Root-to-leaf paths come from iterative self-joins that double the reach of the
ancestor links each round: after k rounds every leaf knows its nearest 2**k
ancestors, so a thread of n turns takes about log2(n) rounds. Only ids are joined
in the rounds; texts join once, at the end. Branches are ranked by the sum of their
nodes' scores (then by leaf id), and each chosen path becomes one conversation.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn, newline after
it. Control strings inside roles and texts (these and those of other chat templates)
get one backslash after their first character; where backslashes are there already,
one more. Undoing it removes one, so the escape is reversible, and no control string
of the template remains inside a text.

Defined cases: null roles and texts are empty; a node whose parent is missing is a
root; a path that runs into a cycle has no root and is left out; repeated node ids
of a conversation count once (least role, then text); nodes without a conversation or
an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and of other chat templates: first character, then the rest.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*(?:{CONTROL}))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*(?:{CONTROL}))", "$1$2")


def paths(nodes: DataFrame, name: str = "chat") -> DataFrame:
    """(conv_id, leaf_id, node_id, dist): every node on the way from each leaf to its root."""
    links = nodes.select("conv_id", "node_id", "parent_id")
    up = links.alias("a").join(links.select("conv_id", F.col("node_id").alias("parent_id")).alias("b"), ["conv_id", "parent_id"])
    up = cut(up.select("conv_id", "node_id", F.col("parent_id").alias("to")), f"{name}-up")
    parents = up.select("conv_id", F.col("to").alias("node_id")).distinct()
    leaves = links.join(parents, ["conv_id", "node_id"], "left_anti")
    reach = leaves.select("conv_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("dist"))
    most = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    step = 1
    while step < most and not up.isEmpty():
        # after this round the ancestors at distances below 2 * step are known
        more = reach.join(up, ["conv_id", "node_id"]).select("conv_id", "leaf_id", F.col("to").alias("node_id"), (F.col("dist") + step).alias("dist"))
        reach = cut(reach.unionByName(more), f"{name}-reach")
        far = up.select("conv_id", F.col("node_id").alias("to"), F.col("to").alias("far"))
        up = cut(up.join(far, ["conv_id", "to"]).select("conv_id", "node_id", F.col("far").alias("to")), f"{name}-up")
        step *= 2
    # what still has ancestors beyond the size of its conversation runs in a cycle
    cyclic = reach.join(up, ["conv_id", "node_id"]).select("conv_id", "leaf_id").distinct() if step >= most and not up.isEmpty() else None
    return reach if cyclic is None else reach.join(cyclic, ["conv_id", "leaf_id"], "left_anti")


def format_reply_trees(nodes: DataFrame, branches: int | None = None, name: str = "chat") -> DataFrame:
    """One row for each chosen branch: conv_id, leaf_id, branch_rank, branch_score,
    formatted, loss_spans (code point start, end of each assistant text in it)."""
    nodes = nodes.filter(F.col("node_id").isNotNull() & F.col("conv_id").isNotNull()).select(
        F.col("conv_id"), "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")
    )
    nodes = nodes.groupBy("conv_id", "node_id").agg(F.min(F.struct("role", "text", "parent_id", "score")).alias("x")).select("conv_id", "node_id", "x.*")
    nodes = cut(nodes, f"{name}-nodes")
    way = paths(nodes, name)
    if branches is not None:
        scored = way.join(nodes.select("conv_id", "node_id", "score"), ["conv_id", "node_id"])
        scored = scored.groupBy("conv_id", "leaf_id").agg(F.sum("score").alias("branch_score"))
        rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("branch_score").desc(), "leaf_id"))
        chosen = scored.withColumn("branch_rank", rank).filter(F.col("branch_rank") <= branches)
        way = way.join(chosen.select("conv_id", "leaf_id"), ["conv_id", "leaf_id"], "left_semi")
    turns = way.join(nodes, ["conv_id", "node_id"])
    parts = F.struct(
        (-F.col("dist")).alias("pos"),
        F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"),
        escape(F.col("text")).alias("body"),
        F.col("role").alias("role"),
    )
    grouped = turns.groupBy("conv_id", "leaf_id").agg(F.sum("score").alias("branch_score"), F.array_sort(F.collect_list(parts)).alias("turns"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("branch_score").desc(), "leaf_id"))
    grouped = grouped.withColumn("branch_rank", rank)
    tail = END + "\n"
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    lengths = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("h"), F.length(t["body"]).alias("b"), (t["role"] == "assistant").alias("a")))
    spans = F.aggregate(
        "lengths",
        F.expr("named_struct('at', 0L, 'out', cast(array() AS array<struct<start:bigint,end:bigint>>))"),
        lambda acc, t: F.struct(
            (acc["at"] + t["h"] + t["b"] + F.lit(len(tail))).cast("long").alias("at"),
            F.when(t["a"], F.concat(acc["out"], F.array(F.struct((acc["at"] + t["h"]).cast("long").alias("start"), (acc["at"] + t["h"] + t["b"]).cast("long").alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return grouped.select("conv_id", "leaf_id", "branch_rank", "branch_score", whole.alias("formatted"), lengths.alias("lengths")).select(
        "conv_id", "leaf_id", "branch_rank", "branch_score", "formatted", spans.alias("loss_spans")
    )


def parse(formatted: Column) -> tuple[Column, Column]:
    """Roles and texts read back from a formatted conversation."""
    one = r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(one), k) for k in (1, 2))
    return F.transform(roles, unescape), F.transform(texts, unescape)


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Linear conversations (rows by turn) as reply trees: each row answers the one before it."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    nodes = rows.withColumn("node_id", order)
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return nodes.select("conv_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
