"""Relations between things sighted in one frame: near and holding, with hysteresis and gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelore.functions import geometry as G


def pairs(sightings: DataFrame, subjects: list[str]) -> DataFrame:
    """sightings(video, frame_id, time_sec, track, class, box) -> pairs of a frame, the subject first; two subjects once, the lower track first."""
    a = sightings.where(F.col("class").isin(subjects)).select("video", "frame_id", "time_sec", F.col("track").alias("subject"), F.col("class").alias("subject_class"), F.col("box").alias("subject_box"))
    b = sightings.select("video", "frame_id", F.col("track").alias("object"), F.col("class").alias("object_class"), F.col("box").alias("object_box"))
    apart = F.col("subject") != F.col("object")
    return a.join(b, ["video", "frame_id"]).where(apart & (~F.col("object_class").isin(subjects) | (F.col("subject") < F.col("object"))))


def islands(scored: DataFrame, frames: DataFrame, gap: float = 3.0, min_hits: int = 2) -> DataFrame:
    """scored(video, subject, object, name, time_sec, keep, enter, score micro-units) -> relations(video, relation_id, subject, object, name, start_sec, end_sec, hits, score_sum).

    keep: the looser limit holds; enter: the stricter one does. A relation starts at an entering row; it goes on while the previous
    frame with sightings (frames: video, time_sec) is no later than gap seconds after the last hit, since gaps are closed only after a frame is scored.
    """
    times = frames.select("video", "time_sec").distinct()
    before = times.withColumn("prev_sec", F.lag("time_sec").over(Window.partitionBy("video").orderBy("time_sec")))
    order = Window.partitionBy("video", "subject", "object", "name").orderBy("time_sec")
    rows = scored.where("keep").join(before, ["video", "time_sec"])
    fresh = F.coalesce((F.col("prev_sec") - F.lag("time_sec").over(order) > gap).cast("long"), F.lit(1))
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    inside = Window.partitionBy("video", "subject", "object", "name", "island").orderBy("time_sec").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("on", F.max(F.col("enter").cast("int")).over(inside)).where("on = 1")
    found = rows.groupBy("video", "subject", "object", "name", "island").agg(F.count(F.lit(1)).alias("hits"), F.min("time_sec").alias("start_sec"), F.max("time_sec").alias("end_sec"), F.sum("score").alias("score_sum"))
    found = found.where(F.col("hits") >= min_hits).drop("island")
    return found.withColumn("relation_id", F.row_number().over(Window.partitionBy("video").orderBy("start_sec", "subject", "object", "name")))


def near(paired: DataFrame, enter: float = 1.0, exit: float = 1.4) -> DataFrame:
    """Distance of the centres in half diagonals; the score falls from 1 at touch to 0 at exit."""
    a, b = F.col("subject_box"), F.col("object_box")
    d = G.center_distance(a, b) / (G.diag(a) / 2 + G.diag(b) / 2)
    rows = paired.withColumn("d", d)
    return rows.select("video", "time_sec", "subject", "object", F.lit("near").alias("name"), (F.col("d") <= exit).alias("keep"), (F.col("d") <= enter).alias("enter"), G.micro(F.greatest(F.lit(0.0), 1 - F.col("d") / exit)).alias("score"))


def holding(paired: DataFrame, person: str = "person", held: list[str] | None = None, enter: float = 0.5, exit: float = 0.3, area: float = 0.35) -> DataFrame:
    """Small things mostly inside a person's box; the score is the share that is inside."""
    from framelore.operators.detections import HOLDABLE

    a, b = F.col("subject_box"), F.col("object_box")
    rows = paired.where((F.col("subject_class") == person) & F.col("object_class").isin(HOLDABLE if held is None else held))
    rows = rows.where((G.area(a) > 0) & (G.area(b) > 0) & (G.area(b) / G.area(a) <= area)).withColumn("s", G.intersection(a, b) / G.area(b))
    return rows.select("video", "time_sec", "subject", "object", F.lit("holding").alias("name"), (F.col("s") >= exit).alias("keep"), (F.col("s") >= enter).alias("enter"), G.micro(F.col("s")).alias("score"))


PAIRS = 1_000_000  # how many pairs are held at once


def near_relations(sightings: DataFrame, subjects: list[str], enter: float = 1.0, exit: float = 1.4, gap: float = 3.0, min_hits: int = 2, shares: int = 4) -> DataFrame:
    """islands(near(pairs(sightings, subjects)), sightings) without storing the pairs, which grow with the square of a frame's sightings.

    A video's subjects are dealt to `shares` tasks; each reads the video's sightings (they must fit there) and pairs its subjects with them, some at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches)).sort_values("frame_id", kind="stable")
        frame, track = pd.factorize(g["frame_id"])[0], np.unique(g["track"].to_numpy(), return_inverse=True)
        names, who, sec, able = *track, g["time_sec"].to_numpy(float), g["able"].to_numpy(bool)
        x, y, w, h = (g[c].to_numpy(float) for c in "xywh")
        middle, far = (x + w / 2, y + h / 2), np.sqrt(w * w + h * h) / 2
        first, end = np.searchsorted(frame, frame, "left"), np.searchsorted(frame, frame, "right")
        times = np.unique(sec)
        place = np.searchsorted(times, sec)
        before = np.where(place > 0, times[place - 1], np.inf)  # the time of the frame before
        own = np.flatnonzero(g["own"].to_numpy(bool))
        own = own[np.lexsort((sec[own], who[own]))]
        edges = np.flatnonzero(np.diff(who[own], prepend=-1))  # where a subject's rows begin
        done = np.append(np.concatenate([[0], np.cumsum(end[own] - first[own])])[edges], np.sum(end[own] - first[own]))
        at, edges = 0, np.append(edges, len(own))
        while at < len(edges) - 1:
            stop = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            some = own[edges[at] : edges[stop]]
            at, n = stop, end[some] - first[some]
            i = np.repeat(some, n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
            apart = (who[i] != who[j]) & (~able[j] | (who[i] < who[j]))
            i, j = i[apart], j[apart]
            dx, dy, reach = middle[0][i] - middle[0][j], middle[1][i] - middle[1][j], far[i] + far[j]
            d = np.divide(np.sqrt(dx * dx + dy * dy), reach, out=np.full(len(i), np.inf), where=reach > 0)
            keep = np.flatnonzero(d <= exit)
            key = who[i[keep]] * np.int64(len(names)) + who[j[keep]]
            order = np.argsort(key, kind="stable")
            keep, key = keep[order], key[order]
            i, j, d = i[keep], j[keep], d[keep]
            if not len(i):
                continue
            fresh = np.append(True, (key[1:] != key[:-1]) | (before[i[1:]] - sec[i[:-1]] > gap))
            island, entered = np.cumsum(fresh) - 1, np.cumsum(d <= enter)
            on = entered > (entered - (d <= enter))[np.flatnonzero(fresh)][island]
            i, j, d, island = i[on], j[on], d[on], island[on]
            if not len(i):
                continue
            a = np.flatnonzero(np.diff(island, prepend=-1))
            z = np.append(a[1:], len(i)) - 1
            score = np.floor(np.maximum(0.0, 1 - d / exit) * 1e6 + 0.5).astype(np.int64)
            rows = pd.DataFrame({"video": g["video"].iloc[0], "subject": names[who[i[a]]], "object": names[who[j[a]]], "hits": z - a + 1, "start_sec": sec[i[a]], "end_sec": sec[i[z]], "score_sum": np.add.reduceat(score, a)})
            yield rows[rows["hits"] >= min_hits]

    kinds = dict(sightings.dtypes)
    parts = int(sightings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = sightings.where(F.col("video").isNotNull() & F.col("frame_id").isNotNull() & F.col("track").isNotNull() & F.col("time_sec").isNotNull())
    flat = known.select("video", "frame_id", F.col("time_sec").cast("double").alias("time_sec"), "track", F.col("class").isin(subjects).alias("able"), *[F.col("box")[k].cast("double").alias(k) for k in "xywh"])
    dealt = flat.withColumn("share", F.explode(F.array(*map(F.lit, range(shares))))).withColumn("own", F.coalesce(F.col("able"), F.lit(False)) & (F.pmod(F.xxhash64("track"), F.lit(shares)) == F.col("share")))
    dealt = dealt.withColumn("able", F.coalesce("able", F.lit(True)))  # as in pairs(): what has no class is no subject, and is paired with lower tracks only
    found = dealt.repartition(parts, "video", "share").groupBy("video", "share").applyInPandas(fold, f"video {kinds['video']}, subject {kinds['track']}, object {kinds['track']}, hits bigint, start_sec double, end_sec double, score_sum bigint")
    # numbered in the order of a video: within a start, after as many as have started before
    found = found.repartition(parts, "video", "start_sec")
    starts = found.groupBy("video", "start_sec").agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*found.columns)).alias("any")).where("any is not null")  # reads all columns, so that the exchange is shared
    starts = starts.withColumn("offset", F.sum("n").over(Window.partitionBy("video").orderBy("start_sec")) - F.col("n")).select("video", "start_sec", "offset")
    rows = found.withColumn("place", F.row_number().over(Window.partitionBy("video", "start_sec").orderBy("subject", "object"))).join(F.broadcast(starts), ["video", "start_sec"])
    return rows.select("video", "subject", "object", F.lit("near").alias("name"), "hits", "start_sec", "end_sec", "score_sum", (F.col("place") + F.col("offset")).cast("int").alias("relation_id"))
