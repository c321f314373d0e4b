"""Reply trees as training conversations, with DataFrame expressions only.

A tree's nodes name their parents. Runs of nodes without a branch are found by pointer doubling: self-joins in which each node jumps to its
pointer's pointer, so a conversation of n turns takes log n of them; then the runs, which form the tree of branches, are walked level by level from
the roots by self-joins. That enumerates root-to-leaf paths; branches are ranked by score, and each chosen path is one conversation.

The template is `<role>text</role>` style with one sign: `<` starts every mark, and never occurs inside a turn, because `\\`, `<`
and `[` of roles and texts are written `\\0`, `\\1` and `\\2`. So control strings in a text cannot act, and reading the turns back is a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

TURN, BODY, END = "<turn ", "<body>", "<end>"


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def runs(nodes: DataFrame) -> DataFrame:
    """nodes(tree, node, parent, w) -> with head, the first node of its unbranched run, and far, its distance from it."""
    kids = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    base = nodes.join(kids.withColumnRenamed("node", "parent"), ["tree", "parent"], "left").join(known, ["tree", "parent"], "left")
    # a head: a root (also a node whose parent is not in the tree), or one of several replies
    base = base.select("tree", "node", F.when(F.col("there") == 1, F.col("parent")).alias("parent"), (F.coalesce("there", F.lit(0)).eqNullSafe(0) | (F.col("kids") > 1)).alias("is_head"))
    ptr = stored(base.select("tree", "node", "parent", F.when(F.col("is_head"), F.col("node")).otherwise(F.col("parent")).alias("to"), F.when(F.col("is_head"), 0).otherwise(1).cast("long").alias("far"), "is_head", F.col("is_head").alias("done")), "chat-runs")
    left = None
    while True:
        now = ptr.where("not done").count()
        if now == 0 or now == left:  # done; or what is left is cycles, which have no root
            return ptr.where("done").drop("done").withColumnRenamed("to", "head")
        left = now
        there = ptr.select("tree", F.col("node").alias("to"), F.col("to").alias("next"), F.col("far").alias("step"), F.col("done").alias("end"))
        moved = ptr.where("not done").join(there, ["tree", "to"])  # nodes that have their head are set aside
        moved = moved.select("tree", "node", "parent", F.col("next").alias("to"), (F.col("far") + F.col("step")).alias("far"), "is_head", F.col("end").alias("done"))
        ptr = stored(ptr.where("done").unionByName(moved), "chat-runs")


def paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """nodes(tree, node, parent, score) -> (tree, leaf, place, node): the chosen root-to-leaf paths, best total score first.

    per_tree: how many paths of a tree are chosen, None for all; ties go to the smaller leaf.
    """
    run = runs(nodes)
    scored = run.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    segment = stored(scored.groupBy("tree", "head").agg(F.sum("score").alias("score"), F.max("far").alias("last"), F.max(F.when(F.col("is_head"), F.struct(F.col("parent"))))["parent"].alias("parent")), "chat-segments")
    up = run.select("tree", F.col("node").alias("parent"), F.col("head").alias("above"))
    segment = stored(segment.join(up, ["tree", "parent"], "left").select("tree", "head", "score", "last", "above"), "chat-segments")
    branching = segment.where("above is not null").select("tree", F.col("above").alias("head")).distinct()
    level = segment.where("above is null").select("tree", "head", F.col("score").alias("total"), F.array(F.struct(F.lit(0).cast("long").alias("start"), "head")).alias("way"), (F.col("last") + 1).alias("size"))
    found = None
    while True:
        level = stored(level, "chat-level")
        found = level if found is None else found.union(level)
        nxt = segment.select("tree", F.col("head").alias("kid"), F.col("above").alias("head"), "score", "last")
        level = level.join(nxt, ["tree", "head"]).select("tree", F.col("kid").alias("head"), (F.col("total") + F.col("score")).alias("total"), F.concat("way", F.array(F.struct(F.col("size").alias("start"), F.col("kid").alias("head")))).alias("way"), (F.col("size") + F.col("last") + 1).alias("size"))
        if level.isEmpty():
            break
    leaves = found.join(branching, ["tree", "head"], "left_anti")
    if per_tree is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("total"), "head")
        leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree)
    chosen = leaves.select("tree", F.col("head").alias("leaf"), F.explode("way").alias("w")).select("tree", "leaf", F.col("w.start").alias("start"), F.col("w.head").alias("head"))
    return chosen.join(run.select("tree", "head", "far", "node"), ["tree", "head"]).select("tree", "leaf", (F.col("start") + F.col("far")).alias("place"), "node")


def render(turns: DataFrame) -> DataFrame:
    """turns(tree, leaf, place, role, text) -> (tree, leaf, formatted, loss: spans of the assistant texts, code points, end exclusive)."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = turns.select("tree", "leaf", "place", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", at.cast("long")).withColumn("end", F.col("start") + F.length("body"))
    whole = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", "head", "body"))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct("start", "end")))).alias("loss"))
    return whole.select("tree", "leaf", F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"), "loss")


def read_back(c: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    parts = F.filter(F.split(c, END), lambda x: F.length(x) > 0)
    return F.transform(parts, lambda x: F.struct(unescape(F.substr(F.substring_index(x, BODY, 1), F.lit(len(TURN) + 1))).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, BODY, 1)) + F.lit(len(BODY) + 1))).alias("text")))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))


def format_trees(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """nodes(tree, node, parent, role, text, score) -> (tree, leaf, formatted, loss), one row for each chosen path.

    Null texts and roles are empty, a null score is 0. Node ids are unique in a tree. A node whose parent is not there is a root; a tree of
    several roots ranks all their paths; nodes on a cycle have no root and are left out. An empty table gives none; very long texts are turns like any other.
    """
    clean = stored(nodes.select("tree", "node", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    way = paths(clean.select("tree", "node", "parent", "score"), per_tree)
    return render(way.join(clean.select("tree", "node", "role", "text"), ["tree", "node"]))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations given as ordered turns: each is a tree of one path. (id_col, formatted, loss).

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own. A null id is one conversation. Null texts and roles are
    empty; an empty table gives none; a very long text is one turn; other columns are ignored.
    """
    own = Window.partitionBy("tree").orderBy("turn", "role", "text")
    plain = rows.select(F.struct(F.col(id_col).alias("id")).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    place = F.row_number().over(own).cast("long")
    nodes = plain.withColumn("node", place).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
    return format_trees(nodes, None).select(F.col("tree.id").alias(id_col), "formatted", "loss")
