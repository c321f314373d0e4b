"""Events of text on screen, and the sightings worth keeping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.functions import geometry as G
from framelore.functions.text import normalize


PAIRS = 1_000_000  # how many overlaps are held at once
SIDES = ["x", "y", "right", "bottom", "area"]


def _sides(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends and the beginnings of texts alike, with a time `at` and the sides and area of the box that stands then; without those of no time."""

    def side(at: str, box: str, ended: bool) -> DataFrame:
        b = F.col(box)
        some = texts.where(F.col("video").isNotNull() & F.col("text").isNotNull() & (F.abs(F.col(at).cast("double")) < float("inf")))
        sides = (b["x"], b["y"], G.right(b), G.bottom(b), G.area(b))
        return some.select("video", "track", F.col(at).cast("double").alias("at"), normalize(F.col("text")).alias("said"), *[c.cast("double").alias(n) for c, n in zip(sides, SIDES)], F.lit(ended).alias("ended"))

    return side("last_sec", "best_box", True), side("first_sec", "first_box", False)


def predecessors(texts: DataFrame, within: float = 3.0, at_least: float = 0.3) -> DataFrame:
    """texts(video, track, text, first_sec, last_sec, first_box, best_box) -> (video, track, before, overlap): every other text that ended up to `within` seconds before
    this one began, said something else and stood in its place. Times are cut into cells of twice `within`: a text is dealt to that of its beginning and to the
    one or two in which those after it begin, so each pair meets once. In a cell both are in order of time, and only those in reach are compared.
    """
    width = 2.0 * within if within > 0 else 1.0
    cell = lambda far: F.floor((F.col("at") + far) / width)
    ended, began = _sides(texts)
    both = ended.withColumn("cell", F.explode(F.sequence(cell(0.0), cell(0.75 * width)))).unionByName(began.withColumn("cell", cell(0.0)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches)).sort_values("at")
        old = g["ended"].to_numpy(bool)
        at, said, track, box = g["at"].to_numpy(), pd.factorize(g["said"])[0], g["track"].to_numpy(), g[SIDES].to_numpy(float).T
        at0, said0, track0, box0, at1, said1, track1, box1 = *(v[..., old] for v in (at, said, track, box)), *(v[..., ~old] for v in (at, said, track, box))
        low, high = np.searchsorted(at0, at1 - 1.5 * within, "left"), np.searchsorted(at0, at1, "right")
        start = 0
        while start < len(low):
            stop = max(start + 1, start + int(np.searchsorted((high[start:] - low[start]) * np.arange(1, len(low) - start + 1), PAIRS, "right")))
            for some in range(low[start], max(high[stop - 1], low[start] + 1), PAIRS):
                i, j = slice(start, stop), slice(some, min(some + PAIRS, high[stop - 1]))
                since = at1[i, None] - at0[None, j]
                overlap = G.overlap(box0[:, None, j], box1[:, i, None])
                m, n = np.nonzero((overlap >= at_least) & (since >= 0) & (since <= within) & (said1[i, None] != said0[None, j]) & (track1[i, None] != track0[None, j]))
                if len(m):
                    yield pd.DataFrame({"video": g["video"].iloc[0], "track": track1[i][m], "before": track0[j][n], "overlap": overlap[m, n]})
            start = stop

    kinds = dict(texts.dtypes)
    spread = both.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video", "cell")  # few rows, but many pairs: not to be coalesced
    return spread.groupBy("video", "cell").applyInPandas(fold, f"video {kinds['video']}, track {kinds['track']}, before {kinds['track']}, overlap double")


class _Ended:
    """The texts of one video that ended up to `within` before now, in order of their ends."""

    def __init__(self, within: float, at_least: float):
        self.within, self.at_least = within, at_least
        self.start = self.size = 0
        self.at, self.track, self.free, self.box, self.said = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, bool), np.zeros((5, 1024)), [""] * 1024

    def add(self, at: float, track: int, said: str, box: tuple) -> None:
        if self.size == len(self.at):
            left = np.flatnonzero(self.free[self.start :]) + self.start
            room = max(1024, 2 * len(left))
            grown = lambda a: np.concatenate([a[..., left], np.zeros((*a.shape[:-1], room - len(left)), a.dtype)], axis=-1)
            self.at, self.track, self.free, self.box = grown(self.at), grown(self.track), grown(self.free), grown(self.box)
            self.said = [self.said[i] for i in left] + [""] * (room - len(left))
            self.start, self.size = 0, len(left)
        n = self.size
        self.at[n], self.track[n], self.free[n], self.box[:, n], self.said[n] = at, track, True, box, said
        self.size += 1

    def claim(self, at: float, track: int, said: str, box: tuple) -> int | None:
        """The free text of other words that overlaps most, of equals the later one; it is free no more."""
        while self.start < self.size and at - self.at[self.start] > self.within:
            self.start += 1
        near = slice(self.start, self.size)
        overlap = G.overlap(self.box[:, near], box)
        some = np.flatnonzero((overlap >= self.at_least) & self.free[near])
        for i in some[np.lexsort((self.track[near][some], overlap[some]))[::-1]] + self.start:
            if self.said[i] != said and self.track[i] != track:
                self.free[i] = False
                return int(self.track[i])
        return None


def text_events(texts: DataFrame, within: float = 3.0, at_least: float = 0.3) -> DataFrame:
    """predecessors()'s texts, numbered by their beginning -> (video, track, type, sec, before): text_changed where a predecessor is claimed, else text_appeared.

    Each takes the free predecessor that overlaps most, of equals the later one, and texts choose in their order. So a video's beginnings and ends are read in order of
    time, in one task, which holds the texts that ended up to `within` ago and not the pairs.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video = pool = None
        for g in batches:
            out = []
            boxes = zip(*[g[c].to_numpy(float).tolist() for c in SIDES])
            for v, at, ended, track, said, box in zip(g["video"].tolist(), g["at"].tolist(), g["ended"].tolist(), g["track"].tolist(), g["said"].tolist(), boxes):
                if pool is None or v != video:
                    video, pool = v, _Ended(within, at_least)
                if ended:
                    pool.add(at, track, said, box)
                elif (before := pool.claim(at, track, said, box)) is not None:
                    out.append((v, track, before))
            yield pd.DataFrame(out, columns=["video", "track", "before"])

    ended, began = _sides(texts)
    both = ended.unionByName(began).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video").sortWithinPartitions("video", "at", F.desc("ended"), "track")
    kind = dict(texts.dtypes)["video"]
    chosen = both.mapInPandas(fold, f"video {kind}, track bigint, before bigint")
    rows = texts.select("video", "track", F.col("first_sec").alias("sec")).join(chosen, ["video", "track"], "left")
    return rows.select("video", "track", F.when(F.col("before").isNull(), "text_appeared").otherwise("text_changed").alias("type"), "sec", "before")


def kept_sightings(obs: DataFrame, delta: float = 0.02) -> DataFrame:
    """obs(video, track, obs_idx, box, ...) -> a track's first and last row, and each whose box differs by more than delta from the last one kept.

    A fold over a track's boxes, as that one depends on the choices before; only their numbers go through Python. delta of 0 or less keeps all.
    """
    if delta <= 0:
        return obs

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("obs_idx")
        at, boxes = g["obs_idx"].tolist(), g[["x", "y", "w", "h"]].to_numpy()
        keep, held = [at[0]], boxes[0]
        for i in range(1, len(at) - 1):
            if abs(boxes[i] - held).max() > delta:
                keep.append(at[i])
                held = boxes[i]
        keep += at[-1:] if len(at) > 1 else []
        return pd.DataFrame({"video": g["video"].iloc[0], "track": g["track"].iloc[0], "obs_idx": keep})

    number = dict(obs.dtypes)["obs_idx"]
    flat = obs.select("video", "track", F.col("obs_idx").cast("bigint").alias("obs_idx"), "box.x", "box.y", "box.w", "box.h")
    chosen = flat.groupBy("video", "track").applyInPandas(fold, "video bigint, track bigint, obs_idx bigint").withColumn("obs_idx", F.col("obs_idx").cast(number))
    return obs.join(chosen, ["video", "track", "obs_idx"], "left_semi")
