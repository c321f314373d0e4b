"""Activity counts over unbounded frame streams, closed by watermarks; for samplers and trackers see trackers.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, time_col: str = "ts", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts by class and tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, every), "class").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time_col: str = "ts", late: str = "10 minutes", gap: str = "3 seconds") -> DataFrame:
    """Lives of tracks by gap timeout alone (no likeness): session windows by (video, track)."""
    return events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), "video", "track").agg(F.count(F.lit(1)).alias("hits"))
