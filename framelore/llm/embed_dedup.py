"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at a cosine of at least t are within eps = sqrt(2 - 2 t). Vectors are rotated to their principal axes and sorted by
the cells of a grid of width eps on the leading ones; the sequence is cut into blocks. Pairs of blocks whose boxes
on the leading axes are further apart than eps are skipped; the others are joined by splitting both intervals
in halves, skipping distant halves, down to leaves that are compared exactly, on the original vectors in double precision.

A pair of blocks returns a count for each linked vector and a spanning tree of its links, never the pairs, so a
group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import Forest, connected_components
from ._store import joined_hot, stored, with_global_rank

AXES = 16  # leading axes whose boxes are compared
GRID = 6  # of these, the ones whose cells order the sequence
LEAF = 512
SLACK = 1e-6


def _units(vectors, wide) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can link, their vectors scaled to length 1)."""
    good, out = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.asarray(v, dtype=np.float64)  # a null component becomes nan
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            good.append(i)
            x = x / top
            out.append(x / np.sqrt(x @ x))
    return np.array(good, dtype=np.int64), np.array(out, dtype=np.float64).reshape(len(out), -1 if out else wide)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal columns, leading first, from the second moments of all unit vectors; summed in two levels."""

    def moments(batches):
        from pyspark import TaskContext

        total = np.zeros((dims, dims))
        for b in batches:
            _, x = _units(b["v"], dims)
            if len(x):
                total += x.T @ x
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % 16], "m": [total.ravel()]})

    parts = vectors.select("v").mapInPandas(moments, "g int, m array<double>")
    rows = parts.groupBy("g").applyInPandas(lambda key, b: pd.DataFrame({"g": [0], "m": [np.stack(b["m"]).sum(axis=0)]}), "g int, m array<double>").collect()  # at most 16
    total = sum((np.array(r["m"]).reshape(dims, dims) for r in rows), np.zeros((dims, dims)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _far(a_lo, a_hi, b_lo, b_hi, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a_lo - b_hi, b_lo - a_hi))
    return float(gap @ gap) > eps * eps + SLACK


def _leaf(x: np.ndarray, y: np.ndarray, raw_x, raw_y, t: float, same: bool) -> np.ndarray:
    cos = x @ y.T
    hit = cos >= t
    for i, j in zip(*np.nonzero(np.abs(cos - t) < 1e-12)):  # as near as rounding: by the definition
        a, b = raw_x[i], raw_y[j]
        hit[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= t
    if same:
        np.fill_diagonal(hit, False)
    return hit


def join_blocks(x, px, ids_x, y, py, ids_y, t: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of two blocks: how many each row of x and of y has, and edges between the numbers of rows (ids_x, ids_y) that span them."""
    eps = np.sqrt(2 - 2 * t)
    count_x, count_y, forest = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), Forest()
    ux, uy = x / np.sqrt((x * x).sum(axis=1))[:, None], y / np.sqrt((y * y).sum(axis=1))[:, None]
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        if same and c < a or a == b or c == d:
            continue
        if not (same and a == c) and _far(px[a:b].min(axis=0), px[a:b].max(axis=0), py[c:d].min(axis=0), py[c:d].max(axis=0), eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            m = (a + b) // 2 if b - a > LEAF else b
            n = (c + d) // 2 if d - c > LEAF else d
            work += [(p, q, r, s) for p, q in ((a, m), (m, b)) for r, s in ((c, n), (n, d))]
            continue
        hit = _leaf(ux[a:b], uy[c:d], x[a:b], y[c:d], t, same and a == c)
        if not hit.any():
            continue
        count_x[a:b] += hit.sum(axis=1)
        if not (same and a == c):
            (count_x if same else count_y)[c:d] += hit.sum(axis=0)
        left = np.ones(b - a, bool)  # rows of x not yet reached: each is visited once as a whole row, so a dense group costs rows, not pairs
        joined = np.zeros(d - c, bool)
        for i in np.flatnonzero(hit.any(axis=1)):
            near = np.flatnonzero(hit[i])
            fresh = near[~joined[near]]
            forest.join(int(ids_x[a + i]), int(ids_y[c + near[0]]))
            if len(fresh) < len(near):  # one already joined stands for all that were joined with it
                for j in {forest.root(int(ids_y[c + k])) for k in near[joined[near]].tolist()}:
                    forest.join(int(ids_x[a + i]), j)
            for j in fresh.tolist():
                forest.join(int(ids_x[a + i]), int(ids_y[c + j]))
            joined[fresh] = True
    return count_x, count_y, forest.edges()


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows(uid, v, p, rank) -> blocks of `block` rows: (block, n, f, uids, raw, low, lo, hi)."""

    def pack(key, g):
        g = g.sort_values("rank")
        p = np.stack(g["p"]).astype(np.float32)
        raw = np.stack(g["v"]).astype(np.float64)
        raw = raw.astype(np.float32) if (raw.astype(np.float32) == raw).all() else raw
        return pd.DataFrame({"block": [int(key[0])], "n": [len(g)], "f": [raw.dtype.itemsize], "uids": [g["uid"].to_numpy().tobytes()], "raw": [raw.tobytes()], "low": [p.tobytes()], "lo": [p.min(axis=0).astype(float)], "hi": [p.max(axis=0).astype(float)]})

    numbered = rows.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    return stored(numbered.groupBy("block").applyInPandas(pack, "block long, n int, f int, uids binary, raw binary, low binary, lo array<double>, hi array<double>"), "ego-blocks")


def _ordered(rows: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """rows(uid, v) with p, their leading coordinates, and rank, their place in epsilon grid order."""
    lead = np.ascontiguousarray(axes[:, :AXES])

    def project(batches):
        for b in batches:
            _, x = _units(b["v"], len(axes))
            p = (x @ lead).astype(np.float32) if len(x) else np.zeros((0, lead.shape[1]), np.float32)
            cells = np.floor(p[:, :GRID] / eps).astype(np.int32)
            yield b.assign(p=list(p), cells=list(cells), fine=p[:, 0] if len(x) else [])

    spread = rows.mapInPandas(project, "uid long, v array<double>, p array<float>, cells array<int>, fine float")
    cols = [F.col("cells")[i].alias(f"c{i}") for i in range(min(GRID, lead.shape[1]))]
    spread = spread.select("uid", "v", "p", *cols, "fine").repartitionByRange(*[f"c{i}" for i in range(len(cols))], "fine", "uid")

    def place(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.assign(part=part, at=np.arange(at, at + len(b)))
            at += len(b)

    inside = spread.sortWithinPartitions(*[f"c{i}" for i in range(len(cols))], "fine", "uid").select("uid", "v", "p")
    inside = stored(inside.mapInPandas(place, "uid long, v array<double>, p array<float>, part int, at long"), "ego-order")
    return with_global_rank(inside.withColumn("all", F.lit(0)), "all", "part", "at", "rank").select("uid", "v", "p", "rank")


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(i, j), i <= j: blocks whose boxes are within eps; met by the cells that they span on the first axis."""
    cell = lambda c: F.floor(c / eps).cast("long")
    boxes = blocks.select("block", "lo", "hi")
    a = boxes.select(F.col("block").alias("i"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(cell(F.col("lo")[0]) - 1, cell(F.col("hi")[0]) + 1)).alias("c"))
    b = boxes.select(F.col("block").alias("j"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]))).alias("c"))
    gap = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, (a["c"] == b["c"]) & (F.col("i") <= F.col("j"))).where(apart <= eps * eps + SLACK).select("i", "j").distinct()


def links(rows: DataFrame, dims: int, threshold: float, block: int) -> DataFrame:
    """rows(uid, v) of one length -> (uid, n, other): links counted by row in parts; other is a row that it links with through some path."""
    eps = float(np.sqrt(2 - 2 * threshold))
    blocks = _blocks(_ordered(rows, principal_axes(rows, dims), eps), block)
    one = blocks.drop("lo", "hi")
    left = one.toDF(*[f"a_{c}" for c in one.columns])
    right = one.toDF(*[f"b_{c}" for c in one.columns])
    both = _pairs(blocks, eps).join(left, F.col("i") == F.col("a_block")).join(right, F.col("j") == F.col("b_block"))
    both = both.withColumn("same", F.col("i") == F.col("j"))

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                read = lambda s, w, f, r=r: np.frombuffer(getattr(r, f"{s}_{w}"), f)
                side = {}
                for s in "ab":
                    n, f = getattr(r, f"{s}_n"), getattr(r, f"{s}_f")
                    side[s] = (read(s, "raw", f"f{f}").astype(np.float64).reshape(n, -1), read(s, "low", "f4").reshape(n, -1), read(s, "uids", "i8"))
                cx, cy, tree = join_blocks(*side["a"], *side["b"], threshold, bool(r.same))
                frames = [pd.DataFrame(tree, columns=["uid", "other"], dtype=np.int64).assign(n=0)]
                for (_, _, uids), n in ((side["a"], cx), (side["b"], cy)):
                    hit = n > 0
                    frames.append(pd.DataFrame({"uid": uids[hit], "other": uids[hit], "n": n[hit]}))
                yield pd.concat(frames)[["uid", "n", "other"]].astype(np.int64)

    return both.drop("i", "j", "a_block", "b_block").mapInPandas(run, "uid long, n long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = 4096) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of vectors.

    n_links counts the other rows at a cosine of at least threshold; component_id is the smallest id of the rows reachable by links; kept marks
    rows that name their component. A vector that is null, empty, zero or holds a null, nan or infinite component links with nothing, and
    vectors of different lengths do not link. Links are of rows: rows with the same id are rows of their own and share a component only
    if links join them. A row with a null id stands alone. An empty table gives none; other columns are ignored.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    source = stored(source.withColumn("uid", F.monotonically_increasing_id()), "ego-source")
    sound = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"
    usable = source.where(sound).select("uid", "v")
    found = None
    for r in usable.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # a row for each length of vector
        some = links(usable.where(F.size("v") == r["d"]), r["d"], threshold, block)
        found = some if found is None else found.union(some)
    if found is None:
        return source.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "ego-links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.where("uid != other").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = source.select("uid", "id").join(counts, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    named = stored(named, "ego-named")
    of_root = named.where("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    out = joined_hot(named, of_root, "root", "n")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
