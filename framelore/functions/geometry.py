"""Column functions over boxes: structs x, y, w, h in 0..1 with a top-left origin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x, y, w, h) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x, y, w, h), "xywh")])


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def area(b: Column) -> Column:
    return F.when((b["w"] <= 0) | (b["h"] <= 0), 0.0).otherwise(b["w"] * b["h"])


def center_x(b: Column) -> Column:
    return b["x"] + b["w"] / 2


def center_y(b: Column) -> Column:
    return b["y"] + b["h"] / 2


def diag(b: Column) -> Column:
    return F.sqrt(b["w"] * b["w"] + b["h"] * b["h"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h)


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    both = area(a) + area(b) - inter
    return F.when(both > 0, inter / both).otherwise(0.0)


def sides(box: np.ndarray) -> np.ndarray:
    """x, y, w, h (the first axis) -> x, y, right, bottom, area."""
    x, y, w, h = box
    return np.stack([x, y, x + w, y + h, np.where((w <= 0) | (h <= 0), 0.0, w * h)])


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """iou() of boxes given by their sides(), the first axis; the others are broadcast."""
    inter = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
    both = a[4] + b[4] - inter
    return np.divide(inter, both, out=np.zeros_like(inter), where=both > 0)


def center_distance(a: Column, b: Column) -> Column:
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(right(a), right(b)) - x).alias("w"), (F.greatest(bottom(a), bottom(b)) - y).alias("h"))


def clamped(b: Column) -> Column:
    """The box within the frame."""
    held = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    x, y = held(b["x"], F.lit(1.0)), held(b["y"], F.lit(1.0))
    return F.when(b.isNotNull(), F.struct(x.alias("x"), y.alias("y"), held(b["w"], 1 - x).alias("w"), held(b["h"], 1 - y).alias("h")))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Pixel corners -> a box within 0..1."""
    held = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    x, y = held(x1 / width), held(y1 / height)
    return F.struct(x.alias("x"), y.alias("y"), (held(x2 / width) - x).alias("w"), (held(y2 / height) - y).alias("h"))


def change(a: Column, b: Column) -> Column:
    """The largest change of a side."""
    return F.greatest(*[F.abs(a[k] - b[k]) for k in "xywh"])


def at_edge(b: Column, margin: float = 0.05, sides: str = "lr") -> Column:
    tests = {"l": b["x"] <= margin, "r": right(b) >= 1 - margin, "t": b["y"] <= margin, "b": bottom(b) >= 1 - margin}
    out = F.lit(False)
    for s in sides:
        out = out | tests[s]
    return out


def valid(b: Column) -> Column:
    out = F.lit(True)
    for k in "xywh":
        out = out & ~F.isnan(b[k]) & (b[k] >= 0) & (b[k] <= 1)
    return out & (right(b) <= 1.0001) & (bottom(b) <= 1.0001)


def micro(c: Column) -> Column:
    """A whole number of millionths, halves up."""
    return F.floor(c * 1e6 + 0.5).cast("long")
