"""Worker heartbeats and fleet health."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.schemas import ACTIVE_WORKER_SECONDS, STALE_WORKER_HOURS, TRANSCODE_SECONDS


def _as_of(epoch: int) -> Column:
    return F.timestamp_seconds(F.lit(epoch))


def seconds_since(seen: Column, as_of: int) -> Column:
    return F.lit(as_of).cast("bigint") - F.unix_seconds(seen)


def latest_heartbeat(heartbeats: DataFrame) -> DataFrame:
    """One row per worker: its most recent heartbeat, ties broken by event id."""
    payload = F.struct("hostname", "last_seen_at", "state", "stats")
    newest = F.max_by(payload, F.struct("last_seen_at", "event_id"))
    return heartbeats.groupBy("worker_id").agg(newest.alias("h")).select("worker_id", "h.*")


def list_workers(workers: DataFrame) -> DataFrame:
    return workers.orderBy(F.col("last_seen_at").desc(), "worker_id")


def remove_workers(workers: DataFrame, leaving: DataFrame) -> DataFrame:
    """Without the workers that signed off."""
    return workers.join(leaving, "worker_id", "left_anti")


def stale_before(as_of: int, hours: int = STALE_WORKER_HOURS) -> Column:
    cutoff = datetime.timedelta(hours=hours).total_seconds()
    return F.col("last_seen_at") < _as_of(int(as_of - cutoff))


def count_stale_workers(workers: DataFrame, as_of: int, hours: int = STALE_WORKER_HOURS) -> DataFrame:
    return workers.agg(F.count_if(stale_before(as_of, hours)).alias("stale_workers"))


def prune_stale_workers(workers: DataFrame, as_of: int, hours: int = STALE_WORKER_HOURS) -> DataFrame:
    return workers.where(~stale_before(as_of, hours))


def active(as_of: int) -> Column:
    return F.col("last_seen_at") >= _as_of(as_of - ACTIVE_WORKER_SECONDS)


def active_peers(workers: DataFrame, as_of: int) -> DataFrame:
    """For every worker, how many others on its host are online and recently seen."""
    online = (F.col("state") != "offline") & active(as_of)
    per_host = workers.groupBy("hostname").agg(F.count_if(online).alias("on_host"))
    own = F.when(online, 1).otherwise(0)
    return workers.join(per_host, "hostname").select(
        "worker_id", "hostname", (F.col("on_host") - own).alias("active_peers")
    )


def active_transcodes(workers: DataFrame, asset: DataFrame, as_of: int) -> DataFrame:
    """Hosts with a recent transcoding worker that still holds an unexpired lease."""
    busy = workers.where(
        (F.col("state") != "offline")
        & (F.col("last_seen_at") >= _as_of(as_of - TRANSCODE_SECONDS))
        & (F.col("stats")["current_stage"] == "transcode")
    )
    leased = asset.where(
        (F.col("status") == "processing") & (F.col("lease_expires_at") > _as_of(as_of))
    ).select("worker_id")
    return busy.join(leased, "worker_id", "left_semi").select("hostname").distinct()


def fleet_health(workers: DataFrame, as_of: int) -> DataFrame:
    """One row: healthy when any worker is active, else degraded with the age of the last heartbeat."""
    totals = workers.agg(
        F.count_if(active(as_of)).alias("active_count"),
        F.count_if(~active(as_of)).alias("stale_count"),
        F.max("last_seen_at").alias("latest"),
    )
    idle = seconds_since(F.col("latest"), as_of).cast("string")
    detail = (
        F.when(
            F.col("active_count") > 0,
            F.concat(
                F.col("active_count").cast("string"),
                F.when(F.col("active_count") == 1, " worker active").otherwise(" workers active"),
            ),
        )
        .when(
            F.col("stale_count") > 0,
            F.concat(F.lit("all workers are stale, the latest seen "), idle, F.lit("s before")),
        )
        .otherwise("no worker is known")
    )
    return totals.select(
        F.when(F.col("active_count") > 0, "healthy").otherwise("degraded").alias("status"),
        detail.alias("detail"), "active_count", "stale_count",
    )


def fleet(workers: DataFrame, schema_version: str) -> DataFrame:
    """Worker listing for a dashboard."""
    return workers.select("worker_id", "state", F.lit(schema_version).alias("version"), "stats")
