"""Motion of tracks: speed in body heights or frame widths, two-threshold segments, actions and moves."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.functions import geometry as G


@dataclass(frozen=True)
class MotionConfig:
    """Speeds in body heights a second for classes that walk, in frame widths for the others."""

    classes: tuple[str, ...] = ("person",)
    walk_enter: float = 0.30
    walk_exit: float = 0.15
    min_segment_seconds: float = 1.0
    object_enter: float = 0.04
    object_exit: float = 0.015
    object_min_move: float = 0.03


def steps(obs: DataFrame, by_height: bool | Column = True) -> DataFrame:
    """obs(video, track, obs_idx, time_sec, box) -> a row per step to the next sighting: dist, dt (1 ms at least), ref and the smoothed speed.

    Smoothing sums distance and time over the step and both neighbours; ref is the mean of their reference sizes: the mean height, 0.001 at least, or 1.
    """
    order = Window.partitionBy("video", "track").orderBy("obs_idx")
    tall = by_height if isinstance(by_height, Column) else F.lit(by_height)
    nxt = obs.withColumn("tall", tall).withColumn("next_box", F.lead("box").over(order)).withColumn("next_sec", F.lead("time_sec").over(order)).where("next_sec is not null")
    a, b = F.col("box"), F.col("next_box")
    ref = F.when(F.col("tall"), F.greatest((a["h"] + b["h"]) / 2, F.lit(1e-3))).otherwise(1.0)
    rows = nxt.select("video", "track", "obs_idx", "time_sec", "next_sec", "tall", G.center_distance(a, b).alias("dist"), F.greatest(F.col("next_sec") - F.col("time_sec"), F.lit(1e-3)).alias("dt"), ref.alias("ref"))
    near = order.rowsBetween(-1, 1)
    return rows.withColumn("speed", F.sum("dist").over(near) / F.sum("dt").over(near) / F.avg("ref").over(near))


def raw_segments(stepped: DataFrame, enter: float = 0.30, exit: float = 0.15, others: tuple[float, float] | None = None) -> DataFrame:
    """Runs of moving and resting steps: (video, track, segment, moving, start_idx, end_idx, start_sec, end_sec).

    A step moves from a speed of `enter` on until one below `exit`; neighbouring runs share a sighting. others: the two limits of tracks that are not measured by
    their height. exit may not exceed enter.
    """
    low, high = others or (enter, exit)
    if exit > enter or high > low:
        raise ValueError("exit may not exceed enter")
    order = Window.partitionBy("video", "track").orderBy("obs_idx")
    limit = lambda a, b: F.when(F.col("tall"), a).otherwise(b)
    state = F.when(F.col("speed") >= limit(enter, low), True).when(F.col("speed") < limit(exit, high), False)
    rows = stepped.withColumn("moving", F.coalesce(F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    turn = F.coalesce((F.col("moving") != F.lag("moving").over(order)).cast("long"), F.lit(0))
    rows = rows.withColumn("segment", F.sum(turn).over(order))
    return rows.groupBy("video", "track", "segment", "moving").agg(F.min("obs_idx").alias("start_idx"), (F.max("obs_idx") + 1).alias("end_idx"), F.min("time_sec").alias("start_sec"), F.max("next_sec").alias("end_sec"))


def absorbed(runs: list[list], least: float) -> list[list]:
    """runs [moving, start_idx, end_idx, start_sec, end_sec] in order: the shortest below `least` (of equals the first) changes its state and joins its neighbours, until there is none or one run is left.

    A heap of spans and a chain of neighbours, so n runs take n log n steps.
    """
    runs = [list(r) for r in runs]
    n = len(runs)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    span = lambda i: runs[i][4] - runs[i][3]
    heap = [(span(i), i) for i in range(n) if span(i) < least]
    heapq.heapify(heap)
    count = n
    while heap and count > 1:
        d, i = heapq.heappop(heap)
        if not alive[i] or d != span(i):
            continue  # it has grown since
        runs[i][0] = not runs[i][0]
        first, last = left[i] if left[i] >= 0 else i, right[i] if right[i] >= 0 else i
        runs[first] = [runs[i][0], runs[first][1], runs[last][2], runs[first][3], runs[last][4]]
        for k in (i, last):
            if k != first and alive[k]:
                alive[k] = False
                count -= 1
        right[first] = right[last]
        if right[last] >= 0:
            left[right[last]] = first
        if span(first) < least:
            heapq.heappush(heap, (span(first), first))
    return [r for r, held in zip(runs, alive) if held]


def absorb(segments: DataFrame, min_seconds: float = 1.0) -> DataFrame:
    """absorbed() for each track; runs that stay too short are dropped. Runs of one track come together (a track is as long as its video)."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        runs = g.sort_values("segment")[["moving", "start_idx", "end_idx", "start_sec", "end_sec"]].itertuples(index=False, name=None)
        out = pd.DataFrame([r for r in absorbed(list(runs), min_seconds) if r[4] - r[3] >= min_seconds], columns=["moving", "start_idx", "end_idx", "start_sec", "end_sec"])
        return out.assign(video=g["video"].iloc[0], track=g["track"].iloc[0], segment=np.arange(len(out)))[list(g.columns)]

    return segments.groupBy("video", "track").applyInPandas(fold, segments.schema)


def movements(obs: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """obs(video, track, class, obs_idx, frame_id, time_sec, conf, box) -> a row per segment: walks (whether its class walks), moving, start_sec, end_sec, frame_id, conf
    (mean over its sightings, both ends in), box and end_box. Each segment is joined with its own sightings by their numbers."""
    person = F.col("class").isin(list(cfg.classes))
    runs = absorb(raw_segments(steps(obs, person), cfg.walk_enter, cfg.walk_exit, (cfg.object_enter, cfg.object_exit)), cfg.min_segment_seconds)
    inside = runs.withColumn("obs_idx", F.explode(F.sequence("start_idx", "end_idx"))).join(obs.select("video", "track", "obs_idx", "frame_id", "conf", "box", person.alias("walks")), ["video", "track", "obs_idx"])
    first, last = (lambda c: F.min_by(c, "obs_idx").alias(c)), (lambda c, to: F.max_by(c, "obs_idx").alias(to))
    return inside.groupBy("video", "track", "segment", "moving", "start_sec", "end_sec").agg(first("walks"), first("frame_id"), F.avg("conf").alias("conf"), first("box"), last("box", "end_box"))


def actions(obs: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """walking and standing of tracks whose class walks: (video, track, action, start_sec, end_sec, conf, frame_id, box)."""
    name = F.when(F.col("moving"), "walking").otherwise("standing").alias("action")
    return movements(obs, cfg).where("walks").select("video", "track", name, "start_sec", "end_sec", "conf", "frame_id", "box")


def object_moves(obs: DataFrame, cfg: MotionConfig = MotionConfig()) -> DataFrame:
    """object_moved for the moving segments of other classes that lead at least object_min_move away: (video, track, type, start_sec, end_sec, frame_id, region)."""
    rows = movements(obs, cfg).where(~F.col("walks") & F.col("moving") & (G.center_distance(F.col("box"), F.col("end_box")) >= cfg.object_min_move))
    return rows.select("video", "track", F.lit("object_moved").alias("type"), "start_sec", "end_sec", "frame_id", G.union(F.col("box"), F.col("end_box")).alias("region"))
