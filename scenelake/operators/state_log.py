"""Changing columns of assets as a log beside the wide table.

A change writes rows of the log only: id, version and the columns that change. The state of an asset is that of its
highest version. The wide table lies in key ranges (`part`); `compact` rewrites the ranges that the log has touched
and no other. Each row of it says up to which version the log has gone into it, so a log that was not cleared after
a compaction is not applied twice, and one that failed halfway is run again.

What computes a change is any function from rows of assets to rows of assets, such as those in `changes`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

STATE = ("status", "worker_id", "lease_expires_at", "error_message", "retry_count", "metadata_status", "analysis_model_id")
ENRICHMENT = ("visual_analysis",)


def write_base(asset: DataFrame, path: str, span: int = 100_000, version: int = 0) -> None:
    """Store assets in ranges of `span` ids. A range is a folder, whatever is in it."""
    part = F.floor(F.col("id") / span).cast("bigint")
    rows = asset.withColumns({"state_version": F.lit(version).cast("bigint"), "part": part})
    rows.repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.mode("errorifexists").partitionBy("part").parquet(path)


def read_base(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _latest(log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, version, s): of each id the state of its highest version."""
    return log.groupBy("id").agg(F.max("version").alias("version"), F.max_by(F.struct(*columns), "version").alias("s"))


def snapshot(base: DataFrame, log: DataFrame | None, columns: tuple[str, ...] = STATE) -> DataFrame:
    """The wide table as the log leaves it. Versions that are in it already have no effect."""
    if log is None:
        return base
    newer = _latest(log, columns).withColumnsRenamed({"version": "n_version", "s": "n_state"})
    applies = F.col("n_version") > F.col("state_version")
    new = {c: F.when(applies, F.col("n_state")[c]).otherwise(F.col(c)).alias(c) for c in columns}
    new["state_version"] = F.greatest("state_version", "n_version").alias("state_version")
    return base.join(newer, "id", "left").select(*(new.get(c, F.col(c)) for c in base.columns))


def append(
    base: DataFrame, log: DataFrame | None, change: Callable[[DataFrame], DataFrame], path: str, version: int,
    columns: tuple[str, ...] = STATE, reads: tuple[str, ...] = ("library_id",),
) -> None:
    """Log what `change` changes. It gets rows of id, `columns` and what else it `reads`; other columns of the wide
    table are not read, and none is written. The same version again replaces itself."""
    wanted = ["id", *dict.fromkeys([*reads, *columns])]
    now = snapshot(base.select(*wanted, "state_version"), log, columns).select(wanted)
    after = change(now).select("id", F.struct(*columns).alias("s"))
    changed = after.join(now.select("id", F.struct(*columns).alias("was")), "id").where(~F.col("s").eqNullSafe(F.col("was")))
    rows = changed.select("id", F.lit(version).cast("bigint").alias("version"), "s.*").withColumn("batch", F.lit(version))
    cut_lineage(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log below a folder; none if nothing was logged."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def compact(spark: SparkSession, path: str, log: DataFrame | None, columns: tuple[str, ...] = STATE, span: int = 100_000) -> None:
    """Bring the log into the wide table. Only ranges that it touches are read and written."""
    if log is None:
        return
    base = read_base(spark, path)
    newer = log.select(F.floor(F.col("id") / span).cast("bigint").alias("part")).distinct()
    touched = base.join(newer, "part", "left_semi")
    # Written aside first: ranges are replaced only by what is complete.
    rows = cut_lineage(snapshot(touched, log, columns).select(base.columns))
    rows.repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("part").parquet(path)
