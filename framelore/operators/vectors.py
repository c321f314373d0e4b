"""Brute-force cosine search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int, most_queries: int = 20_000) -> DataFrame:
    """(query, match, place): each query's k nearest other vectors by cosine; ties (to 12 digits) go to the smaller id.

    The queries are a stated set; they are held against all vectors in blocks of at most most_queries, each sent to every task. A task multiplies its vectors with
    them batch by batch and keeps each query's best k only. Vectors that are null, zero or of another length than a query match nothing.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x != 0)")
    blocks = max(1, -(-q.count() // most_queries))
    best = None
    for b in range(blocks):
        some = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()  # about most_queries
        sides = {}
        for r in some:
            sides.setdefault(len(r["v"]), []).append(r)
        shared = spark.sparkContext.broadcast({d: (np.array([r["query"] for r in rows], np.int64), _units(np.array([r["v"] for r in rows], float))) for d, rows in sides.items()})

        def run(batches, shared=shared):
            held = {d: (np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)) for d, (ids, _) in shared.value.items()}
            for batch in batches:
                for d, (ids, units) in shared.value.items():
                    rows = batch[batch["v"].map(len) == d]
                    if not len(rows):
                        continue
                    v = np.stack(rows["v"]).astype(float)
                    found, v = rows["id"].to_numpy(np.int64), _units(v)
                    near = np.round(units @ v.T, 12)
                    near[~np.isfinite(near)] = -np.inf
                    near[ids[:, None] == found[None]] = -np.inf
                    score = np.hstack([held[d][0], near])
                    name = np.hstack([held[d][1], np.broadcast_to(found, near.shape)])
                    order = np.lexsort((name, -score), axis=1)[:, :k]
                    held[d] = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
            for d, (score, name) in held.items():
                at, place = np.nonzero(np.isfinite(score))
                if len(at):
                    yield pd.DataFrame({"query": shared.value[d][0][at], "match": name[at, place], "c": score[at, place]})

        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x != 0)")
        found = rows.mapInPandas(run, "query long, match long, c double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "match"))
        top = found.withColumn("place", place).where(F.col("place") <= k).select("query", "match", "place")
        best = top if best is None else best.union(top)
    return best


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]
