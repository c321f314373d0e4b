"""Samplers and trackers over unbounded streams, frame by frame in order, with what is open kept as state of a key.

They run the batch operators' linkers, so a stream gives what a batch over the same rows gives. A frame whose time is before the last one's of its
key is an error. Tracks close when a later frame of their key comes more than the gap after them, at a cut, or at a row with end set;
no clock closes them. A micro-batch's rows of a key are sorted by time first.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.operators.tracking import ObjectLinker, TextConfig, TextLinker, TrackConfig

_OBSERVATION = "frame_id bigint, time_sec double, conf double, x double, y double, w double, h double"


def _folded(rows: DataFrame, keys: list[str], key_types: str, out: str, begin, step):
    """rows.groupBy(keys) with a JSON state; step(held, frame, sec, rows of the frame, end) gives output rows and the state to keep, None for none."""
    names = [f.split()[0] for f in f"{key_types}, {out}".split(", ")]

    def run(key, frames, state):
        held = begin(json.loads(state.get[0]) if state.exists else None)
        found = []
        some = [f for f in frames if len(f)]
        g = pd.concat(some).sort_values(["time_sec", "frame_id", "at"], kind="stable") if some else pd.DataFrame()
        if len(g):
            sec, frame = g["time_sec"].to_numpy(), g["frame_id"].to_numpy()
            edges = [0, *(np.flatnonzero((sec[1:] != sec[:-1]) | (frame[1:] != frame[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(edges, edges[1:]):
                found += step(held, int(frame[a]), float(sec[a]), g.iloc[a:b])
        left = held.state()
        if left is None:
            state.remove() if state.exists else None
        else:
            state.update((json.dumps(left),))
        yield pd.DataFrame([(*key, *r) for r in found], columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, f"{key_types}, {out}", "held string", "append", "NoTimeout")


class _Sampler:
    def __init__(self, held):
        self.bucket, self.last = held if held else (None, None)

    def state(self):
        return None if self.last is None else [self.bucket, self.last]


def every_seconds_stream(frames: DataFrame, step: float = 1.0) -> DataFrame:
    """The first frame at or after each multiple of step, as in the batch sampler: (video, frame_id, time_sec, reason). The state is one number a video."""

    def one(held, frame, sec, _):
        if held.last is not None and sec < held.last:
            raise ValueError(f"frame {frame} at {sec} s comes after {held.last} s")
        bucket, before = int(np.floor(sec / step + 1e-9)), held.bucket
        held.last = sec
        if before is not None and bucket <= before:
            return []
        held.bucket = bucket
        return [(frame, sec, "first" if before is None else "interval")]

    return _folded(frames.select("video", "frame_id", "time_sec", F.lit(0).alias("at")), ["video"], "video bigint", "frame_id bigint, time_sec double, reason string", _Sampler, one)


class _Open:
    """A linker with its state as JSON."""

    def __init__(self, linker, held):
        self.linker = linker
        if held:
            live, linker.last_sec = held
            linker.live = [[(*o[:-1], tuple(o[-1])) for o in t] for t in live] if isinstance(linker, ObjectLinker) else [[[(*o[:-1], tuple(o[-1])) for o in t[0]], t[1], t[2]] for t in live]

    def state(self):
        return None if self.linker.last_sec is None else [self.linker.live, self.linker.last_sec]


def _told(tracks: list) -> list[tuple]:
    return [(t[0][0], len(t), i, *o[:-1], *o[-1]) for t in tracks for i, o in enumerate(t)]


def object_tracks_stream(detections: DataFrame, cfg: TrackConfig = TrackConfig()) -> DataFrame:
    """detections(video, class, frame_id, time_sec, det_idx, conf, box, cut, end) -> the sightings of each track when it has ended:
    (video, class, first_frame, hits, obs_idx, frame_id, time_sec, conf, x, y, w, h).

    cut: the frame is the first after a cut, end: it is the last of its video; rows of either may have no box, and have to come for every class that is open.
    """
    rows = detections.select("video", "class", "frame_id", "time_sec", F.col("det_idx").alias("at"), "conf", "box.x", "box.y", "box.w", "box.h", F.coalesce("cut", F.lit(False)).alias("cut"), F.coalesce("end", F.lit(False)).alias("end"))

    def one(held, frame, sec, g):
        sound = g[(g["conf"] >= cfg.min_conf) & (g["w"] > 0) & (g["h"] > 0)]
        if not len(sound) and not g["cut"].any() and not g["end"].any():
            return []
        done = held.linker.frame(frame, sec, sound["conf"].tolist(), list(sound[["x", "y", "w", "h"]].itertuples(index=False, name=None)), bool(g["cut"].any()))
        return _told(done + (held.linker.finish() if g["end"].any() else []))

    return _folded(rows, ["video", "class"], "video bigint, class string", f"first_frame bigint, hits bigint, obs_idx bigint, {_OBSERVATION}", lambda held: _Open(ObjectLinker(cfg), held), one)


def text_tracks_stream(lines: DataFrame, cfg: TextConfig = TextConfig()) -> DataFrame:
    """lines(video, frame_id, time_sec, line_idx, text, conf, box, end) -> the readings of each text track when it has ended."""
    from framelore.functions.text import trimmed

    rows = lines.select("video", "frame_id", "time_sec", F.col("line_idx").alias("at"), trimmed(F.col("text")).alias("text"), "conf", "box.x", "box.y", "box.w", "box.h", F.coalesce("end", F.lit(False)).alias("end"))

    def one(held, frame, sec, g):
        sound = g[(g["text"].fillna("").str.len() >= cfg.min_chars) & (g["conf"] >= cfg.min_conf) & (g["w"] > 0) & (g["h"] > 0)]
        if not len(sound) and not g["end"].any():
            return []
        done = held.linker.frame(frame, sec, [(r.text, r.conf, (r.x, r.y, r.w, r.h)) for r in sound.itertuples()])
        return _told(done + (held.linker.finish() if g["end"].any() else []))

    return _folded(rows, ["video"], "video bigint", f"first_frame bigint, hits bigint, obs_idx bigint, frame_id bigint, time_sec double, text string, conf double, {_OBSERVATION.split('conf double, ')[1]}", lambda held: _Open(TextLinker(cfg), held), one)
