"""Model backends over frames: any callable by name, with retries of passing faults and a limit on frames that fail."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelore.operators.images import sound_image

#: Makers of backends by name; one is made once in each worker. A backend takes (rgb, width, height) and gives rows.
BACKENDS: dict[str, Callable[[], Callable[[bytes, int, int], Iterable[tuple]]]] = {}


class Unavailable(Exception):
    """A fault that may pass: not reached, busy, aborted, out of time or of resources."""


@dataclass(frozen=True)
class RetryConfig:
    """retries below 0: none. The wait doubles each time, with up to half of it more by chance."""

    retries: int = 2
    backoff_seconds: float = 0.2
    timeout_seconds: float = 30.0


def backend(name: str):
    """Register a maker of a backend."""

    def add(maker):
        BACKENDS[name] = maker
        return maker

    return add


def attempts(call: Callable[[], object], cfg: RetryConfig, sleep: Callable[[float], None] = time.sleep):
    """(how many times it was called, its result). Only Unavailable and calls that take too long are tried again; other errors, and the last, are raised with the count."""
    delay, tried = cfg.backoff_seconds, 0
    while True:
        tried += 1
        pool = ThreadPoolExecutor(1)
        try:
            return tried, pool.submit(call).result(cfg.timeout_seconds)
        except (Unavailable, Late) as e:
            if tried > max(0, cfg.retries):
                raise RuntimeError(f"failed after {tried} attempts: {e!r}") from e
        finally:
            pool.shutdown(wait=False)
        sleep(delay + random.uniform(0, delay / 2))
        delay *= 2


def analysed(frames: DataFrame, name: str, schema: str, retry: RetryConfig = RetryConfig()) -> DataFrame:
    """frames(video, frame_id, time_sec, width, height, rgb) -> (video, frame_id, time_sec, error, attempts, found: array of schema), a row per frame.

    A frame that fails has its error and no rows; bytes that do not fit the sides are such an error. Frames are independent, so Spark's tasks run them in parallel; order is by frame_id.
    The maker must be importable on the executors or picklable.
    """
    maker = BACKENDS[name]
    names = [f.split(":")[0].strip() for f in schema.removeprefix("struct<").removesuffix(">").split(",")]
    rows = frames.select("video", "frame_id", "time_sec", "width", "height", "rgb", F.coalesce(sound_image(F.col("width"), F.col("height"), F.col("rgb")), F.lit(False)).alias("sound"))

    def run(batches):
        model = maker()
        for b in batches:
            out = []
            for video, frame, sec, w, h, rgb, sound in b.itertuples(index=False, name=None):
                error, tried, found = None, 0, []
                try:
                    if not sound:
                        raise ValueError("the bytes do not fit the sides")
                    tried, got = attempts(lambda rgb=rgb, w=w, h=h: list(model(rgb, w, h)), retry)
                    found = [dict(zip(names, x)) for x in got]
                except Exception as e:  # noqa: BLE001 - a frame's failure is a result, counted by tolerated()
                    error = str(e) or repr(e)
                out.append((video, frame, sec, error, tried, found))
            yield pd.DataFrame(out, columns=["video", "frame_id", "time_sec", "error", "attempts", "found"])

    return rows.mapInPandas(run, f"video bigint, frame_id bigint, time_sec double, error string, attempts int, found array<{schema}>")


def tolerated(results: DataFrame, max_frame_errors: int = 0) -> DataFrame:
    """analysed() without its failed frames; a video with more of them than max_frame_errors ends the query with the first one's error."""
    failed = F.col("error").isNotNull()
    bad = results.where(failed).select("video", "frame_id", "time_sec", "error")
    place = F.row_number().over(Window.partitionBy("video").orderBy("time_sec", "frame_id"))
    over = bad.withColumn("n", place).where(F.col("n") == max_frame_errors + 1)
    told = F.concat(F.lit("video "), F.col("video").cast("string"), F.lit(", frame "), F.col("frame_id").cast("string"), F.lit(": "), F.col("error"))
    stop = over.select("video", F.raise_error(told).cast("int").alias("stop"))
    return results.where(~failed).join(stop, "video", "left").where(F.col("stop").isNull()).drop("stop", "error")


def warnings(results: DataFrame) -> DataFrame:
    """(video, frame_id, warning) of the frames that failed."""
    return results.where("error is not null").select("video", "frame_id", F.concat(F.lit("frame "), F.col("frame_id").cast("string"), F.lit(" skipped: "), F.col("error")).alias("warning"))
