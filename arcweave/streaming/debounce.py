"""Debouncing of change events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce(changes: DataFrame, gap: str = "150 milliseconds", late: str | None = None) -> DataFrame:
    """``changes(path, ts, op)`` -> one row for each quiet period of a path: ``(path, first_ts, last_ts, n, op)`` with the last op.

    On a stream ``late`` sets the watermark; the same plan runs in batch.
    """
    source = changes.withWatermark("ts", late) if late else changes
    windows = source.groupBy("path", F.session_window("ts", gap).alias("w"))
    return windows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("op", "ts").alias("op")).drop("w")
