"""Filters and aggregates over detections, recognised lines and tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.functions import geometry as G
from framelore.functions import text as X

# The object classes that a person can hold by default (COCO names).
HOLDABLE = [
    "cell phone", "book", "cup", "bottle", "wine glass", "remote", "mouse", "umbrella",
    "handbag", "backpack", "suitcase", "knife", "fork", "spoon", "scissors", "toothbrush",
    "tennis racket", "baseball bat", "skateboard", "frisbee", "sports ball", "banana", "apple",
    "sandwich", "orange", "donut", "cake", "teddy bear",
]


def usable(detections: DataFrame, min_conf: float) -> DataFrame:
    return detections.where((F.col("conf") >= min_conf) & (G.area(F.col("box")) > 0))


def usable_lines(lines: DataFrame, min_chars: int = 2, min_conf: float = 0.0) -> DataFrame:
    rows = lines.withColumn("text", X.trimmed(F.col("text")))
    return rows.where((F.length("text") >= min_chars) & (F.col("conf") >= min_conf) & (G.area(F.col("box")) > 0))


def limited(detections: DataFrame, classes: list[str] | None, min_conf: float = 0.0, most: int = 0) -> DataFrame:
    """A frame's detections of the classes (None or empty: all), most confident first; 0 means the defaults 0.35 and 100."""
    rows = detections.where(F.col("conf") >= (min_conf or 0.35))
    rows = rows.where(F.col("class").isin(classes)) if classes else rows
    place = F.row_number().over(Window.partitionBy("video", "frame_id").orderBy(F.desc("conf"), "det_idx"))
    return rows.withColumn("place", place).where(F.col("place") <= (most or 100))


def lifetimes(obs: DataFrame, min_hits: int = 2) -> DataFrame:
    """obs(video, track, obs_idx, time_sec, conf, ...) -> life and best sighting (the first of the most confident) of each confirmed track."""
    best = F.max_by(F.col("obs_idx"), F.struct("conf", -F.col("obs_idx")))
    rows = obs.groupBy("video", "track").agg(F.count(F.lit(1)).alias("hits"), F.min("time_sec").alias("first_sec"), F.max("time_sec").alias("last_sec"), best.alias("best_idx"), F.max("conf").alias("best_conf"))
    return rows.where(F.col("hits") >= min_hits).withColumn("duration", F.col("last_sec") - F.col("first_sec"))


def numbered_entities(tracks: DataFrame) -> DataFrame:
    """tracks(video, track, class, first_sec, first_x) -> entity_id in order of appearance, seq and name within the class."""
    order = ["first_sec", "class", "first_x", "track"]
    ids = F.row_number().over(Window.partitionBy("video").orderBy(*order))
    seq = F.row_number().over(Window.partitionBy("video", "class").orderBy(*order))
    return tracks.withColumn("entity_id", ids).withColumn("seq", seq).withColumn("name", X.label(F.col("class"), F.col("seq")))


def consensus(readings: DataFrame) -> DataFrame:
    """readings(video, track, obs_idx, text, conf) -> the text with the most confidence, its mean confidence, and the first best reading of it.

    Ties: the text of more bytes, then the first in byte order. conf is scaled to whole thousandths for exact sums.
    """
    votes = readings.groupBy("video", "track", "text").agg(F.sum("conf").alias("weight"), F.count(F.lit(1)).alias("n"), F.max_by("obs_idx", F.struct("conf", -F.col("obs_idx"))).alias("best_idx"))
    place = F.row_number().over(Window.partitionBy("video", "track").orderBy(F.desc("weight"), F.desc(F.octet_length("text")), F.col("text").cast("binary")))
    won = votes.withColumn("place", place).where("place = 1")
    return won.select("video", "track", "text", "weight", "n", "best_idx", (F.col("weight") / F.col("n")).alias("mean_conf"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer brightness of 8-bit colours."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


PAIRS = 1_000_000  # how many overlaps are held at once


def matched(found: DataFrame, truth: DataFrame, at_least: float = 0.5) -> DataFrame:
    """found(video, frame_id, class, det_idx, box), truth(..., truth_idx, box) -> (video, frame_id, class, det_idx, truth_idx, overlap), one to one.

    In a frame and class the pair that overlaps most is taken first, of equals the one with the smaller numbers; a fold over the boxes of one frame.
    """
    return _matched(found, truth, at_least, None, None)


def _matched(found: DataFrame, truth: DataFrame, at_least: float, of_found: str | None, of_truth: str | None) -> DataFrame:
    """matched() with a column of each side, which goes through Python as text, since whole numbers beside nulls would not stay whole there."""

    def side(rows: DataFrame, number: str, true: bool, own: str | None) -> DataFrame:
        known = rows.where(F.col("video").isNotNull() & F.col("frame_id").isNotNull() & F.col("class").isNotNull())
        more = [F.col(own).cast("string").alias("own")] if own else []
        return known.select("video", "frame_id", "class", F.lit(true).alias("true"), F.col(number).cast("long").alias("n"), *[F.col("box")[k].cast("double").alias(k) for k in "xywh"], *more)

    def pick(box: np.ndarray, n: np.ndarray, at: np.ndarray, other: np.ndarray) -> list[tuple]:
        """(row found, true row, overlap) of one frame and class."""
        step, near = max(1, PAIRS // max(1, len(other))), []
        for start in range(0, len(at), step):
            some = at[start : start + step]
            overlap = G.overlap(box[:, some][:, :, None], box[:, other][:, None])
            i, j = np.nonzero(overlap >= at_least)
            near.append((overlap[i, j], some[i], other[j]))
        far, i, j = near[0] if len(near) == 1 else (np.concatenate(c) for c in zip(*near))
        order = np.argsort(-far, kind="stable")  # equals stay in order of their numbers
        i, j, had, taken, held = i[order], j[order], set(), set(), []
        for k, (d, t) in enumerate(zip(n[i].tolist(), n[j].tolist())):
            if d not in had and t not in taken:
                had.add(d)
                taken.add(t)
                held.append(k)
        return list(zip(i[held].tolist(), j[held].tolist(), far[order][held].tolist()))

    keys = ["video", "frame_id", "class"]

    def edges(g: pd.DataFrame) -> list[int]:
        fresh = np.zeros(max(0, len(g) - 1), bool)
        for c in keys:
            v = g[c].to_numpy()
            fresh |= v[1:] != v[:-1]
        return (np.flatnonzero(fresh) + 1).tolist()

    def match(g: pd.DataFrame) -> pd.DataFrame:
        """Of whole frames, in each the boxes found before the true ones."""
        true, n, box = g["true"].to_numpy(bool), g["n"].to_numpy(), G.sides(g[["x", "y", "w", "h"]].to_numpy(float).T)
        first, cuts, out = np.cumsum(true), [0, *edges(g), len(g)], []
        for a, b in zip(cuts, cuts[1:]):
            turn = b - int(first[b - 1] - (first[a - 1] if a else 0))
            if a < turn < b:
                out += pick(box, n, np.arange(a, turn), np.arange(turn, b))
        i, j, far = ([x[k] for x in out] for k in range(3))
        rows = g.iloc[i]
        owned = {c: g["own"].to_numpy()[k] for c, k in ((of_found, i), (of_truth, j)) if c}
        return pd.DataFrame({c: rows[c].to_numpy() for c in keys} | {"det_idx": n[i], "truth_idx": n[j], "overlap": np.array(far, float)} | owned)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # of a frame that may go on in the next batch
        for g in batches:
            if g.empty:
                continue
            cut = max(edges(g), default=0)
            if cut or (rest and edges(pd.concat([rest[-1][-1:], g[:1]]))):
                yield match(pd.concat([*rest, g[:cut]]))
                rest = []
            rest.append(g[cut:])
        if rest:
            yield match(pd.concat(rest))

    kinds = dict(found.dtypes)
    carried = {c: dict(t.dtypes)[c] for t, c in ((found, of_found), (truth, of_truth)) if c}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "det_idx bigint, truth_idx bigint, overlap double", *[f"`{c}` string" for c in carried]])
    both = side(found, "det_idx", False, of_found).unionByName(side(truth, "truth_idx", True, of_truth))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but many pairs: not to be coalesced
    rows = both.repartition(parts, *keys).sortWithinPartitions(*keys, "true", "n").mapInPandas(fold, schema)
    return rows.withColumns({c: F.col(c).cast(kind) for c, kind in carried.items()}) if carried else rows


def precision_recall(found: DataFrame, truth: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Detections against labelled boxes by class: how many there are of each, and how many pairs match one to one."""
    right = matched(found, truth, at_least).groupBy("class").agg(F.count(F.lit(1)).alias("right"))
    n = found.groupBy("class").agg(F.count(F.lit(1)).alias("found"))
    m = truth.groupBy("class").agg(F.count(F.lit(1)).alias("truth"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = n.join(m, "class", "full").join(right, "class", "left").select("class", *[zero(c) for c in ("found", "truth", "right")])
    share = lambda c: F.when(F.col(c) > 0, F.col("right") / F.col(c))
    return rows.withColumn("precision", share("found")).withColumn("recall", share("truth"))


def identity_switches(found: DataFrame, truth: DataFrame, at_least: float = 0.5) -> DataFrame:
    """found with track, truth with truth_track -> (video, truth_track, frames, switches): how often a true thing's matched track changes."""
    rows = _matched(found, truth, at_least, "track", "truth_track")
    before = F.lag("track").over(Window.partitionBy("video", "truth_track").orderBy("frame_id", "truth_idx"))
    rows = rows.withColumn("switch", F.coalesce((F.col("track") != before).cast("long"), F.lit(0).cast("long")))
    return rows.groupBy("video", "truth_track").agg(F.count(F.lit(1)).alias("frames"), F.sum("switch").alias("switches"))


def event_errors(found: DataFrame, truth: DataFrame, within: float) -> DataFrame:
    """found(video, type, sec), truth(video, truth_idx, type, sec) -> (video, truth_idx, type, error): seconds to the nearest found event of the type, null beyond `within`.

    Times are cut into cells of twice `within`: in its own cell a true event meets the last found before and the first after it, in the next ones the last and the first of all.
    """
    width = 2.0 * within if within > 0 else 1.0
    cell = F.floor(F.greatest(F.least(F.col("sec") / width, F.lit(1e15)), F.lit(-1e15)))
    known = found.where(F.col("video").isNotNull() & F.col("type").isNotNull() & F.col("sec").isNotNull() & ~F.isnan(F.col("sec").cast("double"))).select("video", "type", "sec").distinct().withColumn("cell", cell)
    rows = truth.select("video", "type", "sec", "truth_idx", F.lit(None).cast(known.schema["sec"].dataType).alias("at"), F.lit(True).alias("asked")).withColumn("cell", cell)
    both = rows.unionByName(known.select("video", "type", "sec", "cell", F.lit(None).cast(truth.schema["truth_idx"].dataType).alias("truth_idx"), F.col("sec").alias("at"), F.lit(False).alias("asked")))
    cells = Window.partitionBy("video", "type", "cell")
    upto = lambda *order: F.last("at", ignorenulls=True).over(cells.orderBy(*order, "asked").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("before", upto("sec")).withColumn("after", upto(F.desc("sec"))).where("asked")
    ends = known.groupBy("video", "type", "cell").agg(F.min("sec").alias("first"), F.max("sec").alias("last"))
    near = near.join(ends.select("video", "type", (F.col("cell") + 1).alias("cell"), "last"), ["video", "type", "cell"], "left").join(ends.select("video", "type", (F.col("cell") - 1).alias("cell"), "first"), ["video", "type", "cell"], "left")
    errors = [F.abs(F.col(c) - F.col("sec")) for c in ("before", "after", "last", "first")]
    return near.groupBy("video", "truth_idx", "type").agg(F.min(F.least(*[F.when(e <= within, e) for e in errors])).alias("error"))


def reading_accuracy(read: DataFrame) -> DataFrame:
    """read(video, text, truth) -> (video, lines, exact, similarity): lines read without a fault after normalizing, and how alike they are on the average."""
    same = (X.normalize(F.col("text")) == X.normalize(F.col("truth"))).cast("long")
    return read.groupBy("video").agg(F.count(F.lit(1)).alias("lines"), F.sum(same).alias("exact"), F.avg(X.similarity(F.col("text"), F.col("truth"))).alias("similarity"))
