"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum per node and one equi-join, in which the nodes of very many edges are
set apart; no node's neighbours are ever gathered in one task. Each step is written to the
shared folder, so a lost executor costs at most one step, and deletes what the step before wrote.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, stored


class Forest:
    """Union-find over arbitrary integers; the root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x], x = top, p
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _thin(batches):
    """Replace a partition's edges by a star for each component it sees; bounded by flushing."""
    forest = Forest()
    for b in batches:
        for a, c in zip(b["a"].tolist(), b["b"].tolist()):
            forest.join(a, c)
        if len(forest.up) > 500_000:
            yield pd.DataFrame(forest.edges(), columns=["a", "b"], dtype=np.int64)
            forest = Forest()
    yield pd.DataFrame(forest.edges(), columns=["a", "b"], dtype=np.int64)


def _with_least(edges: DataFrame, least: DataFrame, often: int) -> DataFrame:
    """edges(a, b) with m of their a. The few nodes that stand in `often` edges or more are sent to every task, so that no task gets all edges of one."""
    hot = F.broadcast(least.where(F.col("n") >= often).drop("n"))
    cold = edges.join(hot.select("a"), "a", "left_anti").join(least.where(F.col("n") < often).drop("n"), "a")
    return edges.join(hot, "a").unionByName(cold)


def _large_star(edges: DataFrame, often: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, often).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame, often: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, often)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, hot_nodes: int = 50_000) -> DataFrame:
    """edges(a long, b long) -> (node long, root long) for every node that has an edge, root the smallest reachable.

    At most hot_nodes nodes are ever sent to every task: a node counts as hot from 1000 edges, or from as many as let no more than that be hot.
    """
    current = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInPandas(_thin, "a long, b long"), "edges")
    state, n = None, current.count()
    while True:
        often = max(1000, 2 * n // hot_nodes)
        before, current = current, stored(_large_star(current, often), "stars")
        discard(before)
        before, current = current, stored(_small_star(current, often), "stars")
        discard(before)
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state, n = now, now[0]
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
