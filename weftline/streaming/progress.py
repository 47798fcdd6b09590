"""Event logs: throttled progress, append-only logs and incremental refresh, batch and streaming alike.

The time semantics here (windows, watermarks) are an extension: progress events carry
times, and a stream has to know when a window is complete.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def throttled(events: DataFrame, time: str, every: str, order: str, keep: list[str]) -> DataFrame:
    """One row for each window of ``every``: how many events it has and the last one's columns."""
    window = F.window(F.col(time), every)
    rows = events.groupBy(window.alias("w")).agg(F.count("*").alias("n"), *(F.max_by(c, order).alias(c) for c in keep))
    return rows.select(F.col("w.start").alias("window_start"), "n", *keep)


def event_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "json", files: int = 100) -> DataFrame:
    """A folder of log files as a stream; new files are taken ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def throttled_stream(events: DataFrame, time: str, every: str, late: str, order: str, keep: list[str]) -> DataFrame:
    """The streaming twin of throttled(): windows are complete when the watermark has passed them."""
    return throttled(events.withWatermark(time, late), time, every, order, keep)


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a folder of JSON lines, each row once, and ends when the input is used up."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refresh(rows: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch of what is new to ``apply`` and ends; a second call sees newer input only."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SingleFlight:
    """At most one refresh at a time: whoever asks while one runs gets that one."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self._start, self._running, self._lock = start, None, threading.Lock()

    def request(self) -> tuple[StreamingQuery, bool]:
        """The running refresh, and whether this call started it; callers of the same moment get the same one."""
        with self._lock:
            if self._running is not None and self._running.isActive:
                return self._running, False
            self._running = self._start()
            return self._running, True

    def cancel(self) -> None:
        with self._lock:
            if self._running is not None:
                self._running.stop()


def changed_since(fingerprints: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, modified, length) that are new or differ from the snapshot before: the rest is reused."""
    return fingerprints.join(before, ["path", "modified", "length"], "left_anti")
