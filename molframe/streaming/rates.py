"""Streams: duplicate rates in event time, and families that close when their time has passed. An addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark in streams."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if rows.isStreaming else rows


def duplicate_rates(events: DataFrame, ts: str = "ts", key: tuple[str, ...] = ("user_id", "event_type"), window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, events, distinct_keys, duplicate_rate) for each tumbling window, for batches and streams alike; in streams, whose keys are unbounded, distinct keys are estimated by a sketch."""
    rows = _timed(events, ts, late)
    out = rows.groupBy(F.window(ts, window)).agg(F.count("*").alias("events"), (F.approx_count_distinct(F.struct(*key), 0.01) if rows.isStreaming else F.count_distinct(*key)).alias("distinct_keys"))
    return out.select(F.col("window.start").alias("start"), "events", "distinct_keys", (1 - F.col("distinct_keys") / F.col("events")).alias("duplicate_rate"))


def closed_families(reads: DataFrame, family: tuple[str, ...], ts: str = "ts", gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(family, start, size): a family is closed and emitted once no read of it came for `gap`, the stream's counterpart of a change of key in sorted input."""
    rows = _timed(reads, ts, late)
    out = rows.groupBy(*family, F.session_window(ts, gap)).agg(F.count("*").alias("size"))
    return out.select(*family, F.col("session_window.start").alias("start"), "size")


def first_seen(reads: DataFrame, family: tuple[str, ...], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first read of each family in arrival order; unlike the batch operator it can't wait for the best score."""
    return _timed(reads, ts, late).dropDuplicatesWithinWatermark(list(family))
