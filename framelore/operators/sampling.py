"""Frame samplers and image signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every_n(frames: DataFrame, n: int = 30) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("video").orderBy("time_sec", "frame_id")) - 1
    return frames.withColumn("i", place).where(F.col("i") % n == 0).withColumn("reason", F.when(F.col("i") == 0, "first").otherwise("interval")).drop("i")


def every_seconds(frames: DataFrame, step: float = 1.0) -> DataFrame:
    """The first frame at or after each multiple of step: the least of every tumbling bucket."""
    bucket = F.floor(F.col("time_sec") / step + 1e-9)
    rows = frames.withColumn("bucket", bucket).groupBy("video", "bucket").agg(F.min(F.struct("time_sec", "frame_id")).alias("f"))
    first = F.row_number().over(Window.partitionBy("video").orderBy("bucket")) == 1
    return rows.select("video", F.col("f.frame_id").alias("frame_id"), F.col("f.time_sec").alias("time_sec"), F.when(first, "first").otherwise("interval").alias("reason"))


def histogram_score(a: Column, b: Column) -> Column:
    """Half the L1 distance of two histograms (shares)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d) / 2


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two thumbnails, as a share of 255."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d) / F.size(a) / 255


def signature_scores(frames: DataFrame) -> DataFrame:
    """frames(video, frame_id, time_sec, hist, thumb) -> hist_score and mad_score against the frame before (null at the first)."""
    order = Window.partitionBy("video").orderBy("time_sec", "frame_id")
    rows = frames.withColumn("h0", F.lag("hist").over(order)).withColumn("t0", F.lag("thumb").over(order))
    return rows.withColumn("hist_score", histogram_score(F.col("hist"), F.col("h0"))).withColumn("mad_score", mean_difference(F.col("thumb"), F.col("t0"))).drop("h0", "t0")


def scene_changes(scored: DataFrame, hist: float = 0.35, mad: float = 0.12, min_gap: float = 0.25, max_gap: float = 0.0) -> DataFrame:
    """signature_scores() -> sampled frames with reasons first, scene and max_gap: a fold, as both gaps count from the last sampled frame. max_gap 0: off."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for video, frame, sec, h, m in g.sort_values(["time_sec", "frame_id"])[["video", "frame_id", "time_sec", "hist_score", "mad_score"]].itertuples(index=False, name=None):
            since = None if last is None else sec - last
            why = "first" if last is None else "scene" if (h >= hist or m >= mad) and since >= min_gap else "max_gap" if max_gap > 0 and since >= max_gap else None
            if why:
                out.append((video, frame, sec, why))
                last = sec
        return pd.DataFrame(out, columns=["video", "frame_id", "time_sec", "reason"])

    return scored.select("video", "frame_id", "time_sec", "hist_score", "mad_score").groupBy("video").applyInPandas(fold, "video bigint, frame_id bigint, time_sec double, reason string")
