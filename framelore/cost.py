"""A cost log: one JSON line for each stage of a run, read back as a table for media.stage_costs."""

from __future__ import annotations

import json
import resource
import threading
import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "run string, stage string, start string, wall_ms double, cpu_ms double, bytes_in long, bytes_out long, model_calls long, tokens long, model string, note string"


class CostLog:
    """Appends to path; without one, stages are timed and nothing is written."""

    def __init__(self, path: str | None = None, run: str = ""):
        self.path, self.run, self.lock = path, run, threading.Lock()

    @contextmanager
    def stage(self, name: str):
        """Yields the record, whose other fields the stage may set. cpu_ms is that of processes that ended meanwhile. Written also if the stage fails."""
        record = {"run": self.run, "stage": name, "start": datetime.now(timezone.utc).isoformat(), "wall_ms": 0.0, "cpu_ms": 0.0, "bytes_in": 0, "bytes_out": 0, "model_calls": 0, "tokens": 0}
        began, before = time.perf_counter(), _children()
        try:
            yield record
        finally:
            record |= {"wall_ms": (time.perf_counter() - began) * 1000, "cpu_ms": (_children() - before) * 1000}
            if self.path is not None:
                with self.lock, open(self.path, "a") as f:
                    f.write(json.dumps(record) + "\n")


def _children() -> float:
    used = resource.getrusage(resource.RUSAGE_CHILDREN)
    return used.ru_utime + used.ru_stime


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
