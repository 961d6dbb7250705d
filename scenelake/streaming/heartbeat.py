"""Worker liveness over a stream of heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scenelake.operators.workers import latest_heartbeat
from scenelake.schemas import ACTIVE_WORKER_SECONDS


def heartbeat_table(heartbeats: DataFrame) -> DataFrame:
    """Latest heartbeat per worker; written in update mode it upserts the worker table."""
    return latest_heartbeat(heartbeats)


class LivenessProcessor(StatefulProcessor):
    """Emits `active` when a worker is first heard or heard again, `stale` when it falls silent."""

    def __init__(self, silent_after: int):
        self.silent_after = silent_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at_ms bigint, active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["seen_ms"].max()) for pdf in rows)
        was_active = False
        if self.seen.exists():
            before, was_active = self.seen.get()
            newest = max(newest, before)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.silent_after * 1000)
        self.seen.update((newest, True))
        if not was_active:
            yield self._row(key, "active", newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _ = self.seen.get()
        self.seen.update((at, False))
        yield self._row(key, "stale", at)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, status: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"worker_id": [key[0]], "status": [status], "seen_ms": [at]})


def _newest_per_worker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby("worker_id", as_index=False)["last_seen_at"].max()


def liveness_stream(
    heartbeats: DataFrame, silent_after: int = ACTIVE_WORKER_SECONDS, lateness: str = "10 seconds"
) -> DataFrame:
    """Changes between active and stale, in event time of `last_seen_at`.

    Each task first keeps a worker's newest heartbeat per Arrow batch, so a chatty worker sends few rows
    through the shuffle.
    """
    combined = heartbeats.select("worker_id", "last_seen_at").mapInPandas(
        _newest_per_worker, "worker_id string, last_seen_at timestamp"
    )
    timed = combined.withWatermark("last_seen_at", lateness).withColumn(
        "seen_ms", F.unix_millis("last_seen_at")
    )
    return timed.groupBy("worker_id").transformWithStateInPandas(
        statefulProcessor=LivenessProcessor(silent_after),
        outputStructType="worker_id string, status string, seen_ms bigint",
        outputMode="Update", timeMode="EventTime",
    )
