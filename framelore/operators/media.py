"""Packets, frames, indexes and sections of stored streams. Every table has a `video` key; order columns are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_packets(lines: DataFrame, col: str = "line", strict: bool = False) -> DataFrame:
    """`k=v|k=v` lines -> columns pts, dts, duration, size, pos (null where absent or N/A) and key. strict: a packet without pts ends the query with an error."""
    kv = F.str_to_map(F.col(col), F.lit("\\|"), F.lit("="))
    number = lambda k: F.expr(f"try_cast(__kv['{k}'] as bigint)").alias(k)
    rest = [c for c in lines.columns if c != col]
    pts = F.coalesce(F.expr("try_cast(__kv['pts'] as bigint)"), F.raise_error(F.concat(F.lit("a packet without pts: "), F.col(col))).cast("bigint")).alias("pts") if strict else number("pts")
    return lines.withColumn("__kv", kv).select(*rest, pts, *[number(k) for k in ("dts", "duration", "size", "pos")], F.coalesce(F.col("__kv")["flags"].contains("K"), F.lit(False)).alias("key"))


def synthesize_dts(packets: DataFrame) -> DataFrame:
    """packets(video, decode_idx, pts) -> with dts: the sorted pts, delayed by the deepest reordering.

    Places before the delay continue the first gap backwards.
    """
    per = Window.partitionBy("video")
    ranked = packets.select("video", "decode_idx", "pts").withColumn("rank", F.row_number().over(per.orderBy("pts", "decode_idx")) - 1)
    ranked = ranked.withColumn("delay", F.max(F.col("decode_idx") - F.col("rank")).over(per))
    ranked = ranked.withColumn("first", F.min("pts").over(per)).withColumn("gap", F.max(F.when(F.col("rank") == 1, F.col("pts"))).over(per) - F.col("first"))
    at = ranked.select("video", F.col("rank").alias("want"), F.col("pts").alias("dts"))
    out = ranked.withColumn("want", F.col("decode_idx") - F.col("delay")).join(at, ["video", "want"], "left")
    early = F.col("first") + F.col("want") * F.coalesce(F.col("gap"), F.lit(1))
    return out.select("video", "decode_idx", "pts", F.coalesce("dts", early).cast("long").alias("dts"))


def display_frames(packets: DataFrame, time_base: float) -> DataFrame:
    """The i-th frame in display order has the i-th smallest pts: (video, frame_id, pts, time_sec)."""
    place = F.row_number().over(Window.partitionBy("video").orderBy("pts", "decode_idx")) - 1
    return packets.select("video", place.cast("long").alias("frame_id"), "pts", (F.col("pts") * F.lit(time_base)).alias("time_sec"))


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The i-th row of each video's left beside the i-th of its right, as place, l and r; videos with unequal numbers of rows end the query with an error."""
    number = lambda t, order, name: t.select("video", (F.row_number().over(Window.partitionBy("video").orderBy(order)) - 1).cast("long").alias("place"), F.struct(*t.columns).alias(name))
    both = number(left, left_order, "l").join(number(right, right_order, "r"), ["video", "place"], "full")
    uneven = F.col("l").isNull() | F.col("r").isNull()
    message = F.concat(F.lit("video "), F.col("video").cast("string"), F.lit(": the numbers of rows differ at place "), F.col("place").cast("string"))
    return both.withColumn("place", F.when(uneven, F.raise_error(message).cast("long")).otherwise(F.col("place")))


def access_units(streams: DataFrame) -> DataFrame:
    """streams(video, stream: bytes of Annex B) -> (video, place, offset, size) of the coded frames, which begin with a delimiter.

    A frame begins with a start code (00 00 01, and a zero before it) in front of a unit of type 9; a stream that does not begin with one is an error.
    """
    import re

    import pandas as pd

    begin = re.compile(rb"\x00?\x00\x00\x01[\x09\x29\x49\x69\x89\xa9\xc9\xe9]")

    def run(batches):
        for b in batches:
            out = []
            for video, stream in zip(b["video"], b["stream"]):
                starts = [m.start() for m in begin.finditer(stream)]
                if not starts or starts[0]:
                    raise ValueError(f"video {video}: the stream does not begin with an access unit delimiter")
                out += [(video, i, a, z - a) for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(stream)]))]
            yield pd.DataFrame(out, columns=["video", "place", "offset", "size"])

    return streams.select("video", "stream").mapInPandas(run, "video bigint, place bigint, offset bigint, size bigint")


def frame_records(packets: DataFrame, units: DataFrame, source: Column, target: Column, shift: Column | None = None) -> DataFrame:
    """packets(video, decode_idx, pts, dts, key) and access_units() -> (video, decode_idx, pts, dts, offset, size, flags) in target ticks; unequal numbers are an error."""
    from framelore.functions import text as X

    rows = zipped(packets, units, "decode_idx", "place")
    tick = lambda c: (X.rescale(F.col(c), source, target, True) + (F.lit(0) if shift is None else shift)).cast("long").alias(c)
    rows = rows.select("video", F.col("place").alias("decode_idx"), "l.pts", "l.dts", "l.key", "r.offset", "r.size")
    return rows.select("video", "decode_idx", tick("pts"), tick("dts"), "offset", "size", F.col("key").cast("int").alias("flags"))


def widest_gap(mode: str, seconds: float = 1.0, n: int = 30, fps: float | None = None, max_gap_seconds: float = 0.0) -> float | None:
    """The longest time a sampler goes without a frame; None without a bound."""
    if mode == "every_seconds":
        return seconds or 1.0
    if mode == "every_n":
        return (n or 30) / fps if fps else None
    return max_gap_seconds or None


def sampling_warnings(gap: float | None, bridged: float = 3.0) -> list[str]:
    """What to tell of a sampler with such gaps, where tracks bridge `bridged` seconds."""
    if gap is not None and gap <= bridged:
        return []
    told = "without a bound" if gap is None else f"up to {gap:.1f} s"
    return [f"gaps between sampled frames are {told}, but tracks bridge {bridged:.1f} s only: one thing will become several entities"]


def duration_runs(packets: DataFrame) -> DataFrame:
    """Run lengths of frame durations (dts differences; the last frame repeats the one before): (video, run, frames, duration)."""
    order = Window.partitionBy("video").orderBy("decode_idx")
    d = F.lead("dts").over(order) - F.col("dts")
    rows = packets.withColumn("d", d).withColumn("d", F.coalesce("d", F.lag("d").over(order), F.lit(0)))
    rows = rows.withColumn("run", F.sum(F.coalesce((F.col("d") != F.lag("d").over(order)).cast("long"), F.lit(1).cast("long"))).over(order))
    return rows.groupBy("video", "run").agg(F.count(F.lit(1)).alias("frames"), F.max("d").alias("duration"))


def pixel_summary(packets: DataFrame) -> DataFrame:
    return packets.groupBy("video").agg(F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), F.max(F.col("pts") + F.col("dur")).alias("end_pts"), F.sum(F.col("key").cast("long")).alias("keys"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("frames"))


def choose_mode(codec: Column, pix_fmt: Column, base_num: Column, base_den: Column) -> tuple[Column, Column]:
    """(whether the pixels can be copied, the time scale: a time base's denominator where its numerator is 1, else 90000)."""
    return (codec == "h264") & (pix_fmt == "yuv420p"), F.when(base_num == 1, base_den).otherwise(90000)


def frame_at(index: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of: for each probe(video, probe, t) the index row(video, decode_idx, pts) with the greatest pts <= t, the later of equals.

    Before the first frame it is index 0. One sort of both sides by (video, time); no theta join.
    """
    a = index.select("video", F.col("pts").alias("t"), F.lit(0).alias("side"), F.col("decode_idx"), F.lit(None).cast("long").alias("probe"))
    b = probes.select("video", "t", F.lit(1).alias("side"), F.lit(None).cast("long").alias("decode_idx"), F.col("probe").cast("long"))
    upto = Window.partitionBy("video").orderBy("t", "side", "decode_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("at", F.coalesce(F.last("decode_idx", ignorenulls=True).over(upto), F.lit(0)))
    return found.where("side = 1").select("video", "probe", "t", F.col("at").alias("decode_idx"))


def seek_key(index: DataFrame) -> DataFrame:
    """index(video, decode_idx, key) -> with seek, the last key frame at or before, else 0."""
    upto = Window.partitionBy("video").orderBy("decode_idx").rowsBetween(Window.unboundedPreceding, 0)
    return index.withColumn("seek", F.coalesce(F.last(F.when(F.col("key"), F.col("decode_idx")), ignorenulls=True).over(upto), F.lit(0)))


def find_section(sections: DataFrame, type_: int, layer: int) -> DataFrame:
    """The first section of a type and layer in each file."""
    return sections.where((F.col("type") == type_) & (F.col("layer") == layer)).groupBy("path").agg(F.min("idx").alias("idx"))


def find_range(sections: DataFrame, type_: int, layer: int, start: int, end: int) -> DataFrame:
    """Sections that overlap [start, end], both ends in; a section of 0..0 covers the whole stream. By start, then place."""
    whole = (F.col("start") == 0) & (F.col("end") == 0)
    hit = sections.where((F.col("type") == type_) & (F.col("layer") == layer) & (whole | ((F.col("start") <= end) & (F.col("end") >= start))))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("start", "idx")))


def stage_costs(log: DataFrame) -> DataFrame:
    """Means and totals of a cost log by stage."""
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.avg("wall_ms").alias("wall_ms"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))


def break_even(costs: DataFrame) -> DataFrame:
    """(encode, query, baseline) costs -> how many queries repay an encoding; null where they never do."""
    saved = F.col("baseline") - F.col("query")
    return costs.withColumn("break_even", F.when(saved > 0, F.ceil(F.col("encode") / saved)).cast("long"))
