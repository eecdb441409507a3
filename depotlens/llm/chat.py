"""Chat formatting of reply trees; DataFrame operations only.

Messages name their parents. Ancestors are found by iterative self-joins on
pointers that double their reach, so a chain of n turns takes log2(n) joins; the
expansion from each leaf then lists its root-to-leaf path exactly once. Branches
are ranked by score, and each chosen path becomes one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_table

START, SEP, END = "<|im_start|>", "\n", "<|im_end|>"
#: Control strings of common chat templates, all escaped in texts.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PATTERN = r"<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])"

#: Role and text of a turn: the role ends at the first line break that no backslash precedes.
_TURN = r"(?s)^((?:[^\\\n]++|\\.)*+)\n(.*)$"


def escape(text: Column) -> Column:
    """Double every backslash, then put one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _PATTERN, r"$0\\")


def escape_role(role: Column) -> Column:
    """As escape; a line break is escaped too, since the first bare one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    """A backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, msg, parent) to (tree, leaf, msg, up): every message above each leaf, ``up`` steps from it.

    A message whose parent is null or unknown is a root. Messages on a cycle hang
    on no root; they end the doubling at 62 rounds and reach no leaf.
    """
    nodes = messages.select("tree", "msg", "parent")
    known = nodes.select("tree", F.col("msg").alias("parent"))
    jump = cut(nodes.join(known, ["tree", "parent"]).select("tree", "msg", F.col("parent").alias("to")))
    leaves = nodes.join(nodes.select("tree", F.col("parent").alias("msg")).filter("msg is not null"), ["tree", "msg"], "left_anti")
    jumps = []
    while len(jumps) < 62 and not jump.isEmpty():
        jumps.append(jump)
        on = jump.select("tree", F.col("msg").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(on, ["tree", "to"]).select("tree", "msg", F.col("far").alias("to")))
    rows = leaves.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        step = F.array(F.struct("msg", "up"), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("msg"), (F.col("up") + (1 << k)).alias("up"))))
        rows = rows.join(jumps[k], ["tree", "msg"], "left").select("tree", "leaf", F.explode(F.array_compact(step)).alias("s")).select("tree", "leaf", "s.msg", "s.up")
        if k % 4 == 0:
            rows = cut(rows)
    return rows


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Reply trees (tree, msg, parent, role, text, score) to one row per chosen branch.

    Returns tree, leaf, rank (by the path's mean score, ties by leaf), formatted,
    and loss: (start, length) in code points of each assistant text inside
    ``formatted``. Null role, text or score count as empty, empty and 0; rows
    without tree or msg are left out, repeated (tree, msg) keep one row; other
    columns are ignored. ``branches`` keeps the best few of a tree, None all.
    """
    clean = messages.filter("tree is not null and msg is not null").groupBy("tree", "msg").agg(
        F.max(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")
    )
    clean = clean.select("tree", "msg", "m.*")
    paths = cut(reply_paths(clean))
    scored = paths.join(clean.select("tree", "msg", "score"), ["tree", "msg"])
    branch = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    branch = branch.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).drop("score")
    if branches is not None:
        branch = branch.filter(F.col("rank") <= branches)
    turn = F.struct((-F.col("up")).alias("at"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("own"))
    turns = paths.join(branch, ["tree", "leaf"]).join(clean.select("tree", "msg", "role", "text"), ["tree", "msg"])
    one = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP))
    tail = F.lit(END + "\n")
    one = one.withColumn("parts", F.transform("turns", lambda t: F.concat(head(t), t["text"], tail)))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + F.length(t["text"]) + len(END) + 1).alias("at"),
            F.when(t["own"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(head(t))).alias("start"), F.length(t["text"]).cast("long").alias("length"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return one.select("tree", "leaf", "rank", F.array_join("parts", "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    pieces = F.transform(pieces, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END) - 1))
    part = lambda x, k: unescape(F.regexp_extract(x, _TURN, k))
    return F.transform(pieces, lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees in which every turn answers the one before it.

    Equal turns are ordered by role and text. Only ids and the order's keys are sorted.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = conversations.filter("conv_id is not null").withColumn("msg", F.row_number().over(w).cast("long"))
    return n.select(F.col("conv_id").alias("tree"), "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
