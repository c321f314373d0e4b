"""Work on the pixels of frames: signatures, a stand-in detector that finds plain colours, and reuse of recognised text.

Frames are rows (video, frame_id, time_sec, width, height, rgb); rgb has three bytes a pixel, row by row. Pixels are read in
mapInPandas, a batch of frames at a time, and go no further than these operators: what they return is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = (48, 27)  # columns and rows of the cells that are compared for text reuse

# The stand-in's classes, their numbers in the detector's list and the channel that is bright in them.
COLOURS = {"person": (0, 0), "cell phone": (67, 2)}
TEXT_CHANNEL, STAND_IN_CONF = 1, 0.9


def sound_image(width: Column, height: Column, rgb: Column, longest: int = 16384) -> Column:
    """Whether sides are within 1..longest and the bytes are as many as they say."""
    side = lambda c: (c >= 1) & (c <= longest)
    return F.coalesce(side(width) & side(height) & (F.octet_length(rgb) == width.cast("long") * height * 3), F.lit(False))


def _pixels(rgb: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def _brightness(pixels: np.ndarray) -> np.ndarray:
    """Thousandths, whole numbers."""
    return pixels.astype(np.int64) @ np.array([299, 587, 114])


def signature(rgb: bytes, width: int, height: int, step: int = 4, bins: int = 64, thumb: tuple[int, int] = (16, 9)) -> tuple[np.ndarray, np.ndarray]:
    """(shares of whole brightness levels in bins, mean level of each thumbnail cell; 0 where no pixel was read), from every step-th pixel both ways."""
    level = _brightness(_pixels(rgb, width, height)[::step, ::step]) // 1000
    across, down = np.arange(0, width, step) * thumb[0] // width, np.arange(0, height, step) * thumb[1] // height
    cell = (down[:, None] * thumb[0] + across).ravel()
    size = thumb[0] * thumb[1]
    n = np.bincount(cell, minlength=size)
    return np.bincount((level * bins // 256).ravel(), minlength=bins) / level.size, np.bincount(cell, level.ravel(), size) / np.maximum(n, 1)


def _strides(length: int, cells: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Every step-th place of each of the cells that length is cut into, and the cell it lies in."""
    cuts = np.arange(cells + 1) * length // cells
    at = [np.arange(a, b, step) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate(at), np.repeat(np.arange(cells), [len(a) for a in at])


def grid_means(rgb: bytes, width: int, height: int, grid: tuple[int, int] = GRID, step: int = 3) -> np.ndarray:
    """Mean brightness of each cell, row by row; 0 where a cell has no pixel."""
    (xs, cx), (ys, cy) = _strides(width, grid[0], step), _strides(height, grid[1], step)
    cell = (cy[:, None] * grid[0] + cx).ravel()
    size = grid[0] * grid[1]
    total = np.bincount(cell, _brightness(_pixels(rgb, width, height)[ys][:, xs]).ravel() / 1000, size)
    return (total / np.maximum(np.bincount(cell, minlength=size), 1)).astype(np.float32)


def regions(mask: np.ndarray, least: int = 4) -> list[tuple[int, int, int, int]]:
    """Corners (x1, y1, x2, y2) of the groups of at least `least` cells that touch along a side, by their first cell. Runs of a row are joined to those they overlap above."""
    runs, up, above = [], [], []
    for y, row in enumerate(mask):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            runs.append((a, y, b))
            up.append(len(up))
            here.append(up[-1])
            for k in above:
                if runs[k][0] < b and a < runs[k][2]:
                    i, j = (_top(up, k), _top(up, here[-1]))
                    up[max(i, j)] = min(i, j)
        above = here
    found: dict[int, list[int]] = {}
    for k, (a, y, b) in enumerate(runs):
        g = found.setdefault(_top(up, k), [a, y, b, y + 1, 0])
        found[_top(up, k)] = [min(g[0], a), min(g[1], y), max(g[2], b), max(g[3], y + 1), g[4] + b - a]
    return [tuple(g[:4]) for _, g in sorted(found.items()) if g[4] >= least]


def _top(up: list[int], k: int) -> int:
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


def plain_colour(rgb: bytes, width: int, height: int, channel: int, step: int = 4) -> list[tuple[float, float, float, float]]:
    """Boxes of regions where one channel is above 170 and the others are under 90, on every step-th pixel."""
    small = _pixels(rgb, width, height)[::step, ::step]
    others = [c for c in range(3) if c != channel]
    rows, cols = small.shape[:2]
    mask = (small[..., channel] > 170) & (small[..., others] < 90).all(axis=2)
    return [(x1 / cols, y1 / rows, (x2 - x1) / cols, (y2 - y1) / rows) for x1, y1, x2, y2 in regions(mask)]


def _per_frame(frames: DataFrame, read, schema: str) -> DataFrame:
    """read(rgb, width, height) -> rows, over all sound frames; keys are carried."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = [(v, f, t, *row) for v, f, t, w, h, rgb in b.itertuples(index=False, name=None) for row in read(rgb, w, h)]
            yield pd.DataFrame(out, columns=["video", "frame_id", "time_sec", *names])

    rows = frames.where(sound_image(F.col("width"), F.col("height"), F.col("rgb"))).select("video", "frame_id", "time_sec", "width", "height", "rgb")
    return rows.mapInPandas(run, f"video bigint, frame_id bigint, time_sec double, {schema}")


def signatures(frames: DataFrame) -> DataFrame:
    """(video, frame_id, time_sec, hist, thumb), as sampling.signature_scores takes them. Frames whose bytes do not fit their sides are left out."""
    return _per_frame(frames, lambda rgb, w, h: [signature(rgb, w, h)], "hist array<double>, thumb array<double>")


def cell_means(frames: DataFrame) -> DataFrame:
    """(video, frame_id, time_sec, grid); grid is null for frames smaller than it."""
    return _per_frame(frames, lambda rgb, w, h: [(grid_means(rgb, w, h) if w >= GRID[0] and h >= GRID[1] else None,)], "grid array<float>")


_BOXED = "x double, y double, w double, h double"


def stand_in_detections(frames: DataFrame, classes: list[str] | None = None, most: int = 100) -> DataFrame:
    """Red regions as persons and blue ones as phones: (video, frame_id, time_sec, det_idx, class, class_id, conf, box)."""

    def read(rgb, w, h):
        found = [(name, number, *b) for name, (number, channel) in COLOURS.items() if not classes or name in classes for b in plain_colour(rgb, w, h, channel)]
        return [(i, *f[:2], STAND_IN_CONF, *f[2:]) for i, f in enumerate(found[:most])]

    return _per_frame(frames, read, f"det_idx bigint, class string, class_id int, conf double, {_BOXED}").withColumn("box", F.struct("x", "y", "w", "h")).drop("x", "y", "w", "h")


def stand_in_lines(frames: DataFrame, text: str = "FAKE TEXT") -> DataFrame:
    """Green regions as lines that all say `text`: (video, frame_id, time_sec, line_idx, text, conf, box)."""
    read = lambda rgb, w, h: [(i, text, STAND_IN_CONF, *b) for i, b in enumerate(plain_colour(rgb, w, h, TEXT_CHANNEL))]
    return _per_frame(frames, read, f"line_idx bigint, text string, conf double, {_BOXED}").withColumn("box", F.struct("x", "y", "w", "h")).drop("x", "y", "w", "h")


def text_sources(grids: DataFrame, levels: float = 6.0) -> DataFrame:
    """cell_means() -> (video, frame_id, source): the frame whose text is read for this one, itself unless every cell is within
    `levels` of the last frame that was read. A fold over a video, as that frame depends on the decisions before it. Frames without a
    grid are read themselves and are no one's source; levels of 0 or less: all are read.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["time_sec", "frame_id"])
        out, base, at = [], None, None
        for video, frame, grid in g[["video", "frame_id", "grid"]].itertuples(index=False, name=None):
            source = frame
            if grid is not None and levels > 0:
                now = np.asarray(grid, np.float32)
                if base is not None and (np.abs(now - base) < levels).all():
                    source = at
                else:
                    base, at = now, frame
            out.append((video, frame, source))
        return pd.DataFrame(out, columns=["video", "frame_id", "source"])

    return grids.select("video", "frame_id", "time_sec", "grid").groupBy("video").applyInPandas(fold, "video bigint, frame_id bigint, source bigint")


def carried_lines(sources: DataFrame, lines: DataFrame) -> DataFrame:
    """text_sources() and lines(video, frame_id, ...) of the frames that were read -> every frame's lines, with reused. A frame whose source failed to be read has none."""
    own = lines.drop("time_sec").withColumnRenamed("frame_id", "source")
    return sources.join(own, ["video", "source"]).withColumn("reused", F.col("source") != F.col("frame_id")).drop("source")
