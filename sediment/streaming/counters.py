"""Streaming aggregates: request counters, turn counters, and event-time windows as an extension."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT


def request_counters(events: DataFrame) -> DataFrame:
    """Per request: first and last time, events, calls and milliseconds in calls (update or complete mode)."""
    call = F.col("event_type") == "purchase"
    return events.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(call).alias("calls"), F.round(F.sum(F.when(call, F.col("value")).otherwise(0.0)), 4).alias("call_ms"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value by window and type with a watermark. The time column becomes a timestamp with the session's zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


class _Due(StatefulProcessor):
    def __init__(self, every: int, ttl_ms: int | None) -> None:
        self.every, self.ttl_ms = every, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "n long, upto long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        n, upto = self.now.get() or (0, 0)
        for i in sorted(r.id for r in rows):
            n, upto = n + 1, max(upto, i)
            if n >= self.every:
                yield Row(conv_id=key[0], n=n, upto=upto)
                n = 0
        self.now.update((n, upto))

    def close(self) -> None:
        pass


def due_summaries(turns: DataFrame, every: int = DEFAULT.summarize_every, ttl_ms: int | None = 86_400_000) -> DataFrame:
    """(conv_id, n, upto) each time a conversation has ``every`` turns since its last summary; the offset moves on.

    turns: conv_id, id. State is a count and the largest id, and goes ``ttl_ms``
    after it was last written (None, for streams that are drained: never). It
    needs RocksDB: start streams under ``state.rocksdb``.
    """
    return turns.groupBy("conv_id").transformWithState(_Due(every, ttl_ms), "conv_id long, n long, upto long", "Append", "ProcessingTime" if ttl_ms else "None")
