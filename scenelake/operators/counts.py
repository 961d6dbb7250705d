"""Counts and roll-ups over the catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.paths import has_media_suffix
from scenelake.operators.catalog import live_assets, live_libraries
from scenelake.schemas import FINISHED, MEDIA_SUFFIXES


def unfinished():
    return ~F.col("status").isin(*FINISHED)


def count_assets(asset: DataFrame, slug: str, status: str | None = None) -> DataFrame:
    """Assets of a library, in the trash or not, optionally in one status."""
    rows = asset.where(F.col("library_id") == slug)
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.agg(F.count("*").alias("assets"))


def pending_counts(asset: DataFrame, library: DataFrame, slug: str | None = None) -> DataFrame:
    """Per live library the pending assets, and those of them with a media suffix."""
    waiting = live_assets(asset.where(F.col("status") == "pending"), library, slug)
    media = has_media_suffix(asset, MEDIA_SUFFIXES)
    return waiting.groupBy("library_id").agg(
        F.count("*").alias("pending"), F.count_if(media).alias("pending_proxyable")
    )


def catalog_stats(asset: DataFrame, library: DataFrame) -> DataFrame:
    """One row of totals; assets of trashed libraries count too."""
    scanning = live_libraries(library).agg(F.bool_or(F.col("scan_status") == "scanning")).scalar()
    return asset.agg(
        F.count("*").alias("total_assets"),
        F.count_if(F.col("status") == "pending").alias("pending_assets"),
        F.count_if(unfinished()).alias("pending_ai_count"),
    ).withColumn(
        "is_analyzing", (F.col("pending_ai_count") > 0) | F.coalesce(scanning, F.lit(False))
    )


def library_status(asset: DataFrame, library: DataFrame) -> DataFrame:
    """Live libraries with their unfinished work; counted per library before the join."""
    work = asset.groupBy(F.col("library_id").alias("slug")).agg(F.count_if(unfinished()).alias("n"))
    pending = F.coalesce("n", F.lit(0))
    return live_libraries(library).join(work, "slug", "left").select(
        "slug", F.coalesce("name", "slug").alias("name"), pending.alias("pending_ai"),
        ((F.col("scan_status") == "scanning") | (pending > 0)).alias("is_analyzing"),
    )


def any_analyzing(asset: DataFrame, library: DataFrame, slugs: Iterable[str] | None = None) -> DataFrame:
    """One row telling whether search over these libraries may still be incomplete."""
    status = library_status(asset, library)
    if slugs is not None:
        status = status.where(F.col("slug").isin(list(slugs)))
    return status.agg(F.coalesce(F.bool_or("is_analyzing"), F.lit(False)).alias("incomplete"))


def stale_leases(asset: DataFrame, as_of: int, slug: str | None = None) -> DataFrame:
    rows = asset if slug is None else asset.where(F.col("library_id") == slug)
    expired = (F.col("status") == "processing") & (
        F.col("lease_expires_at") < F.timestamp_seconds(F.lit(as_of))
    )
    return rows.where(expired).groupBy("library_id").agg(F.count("*").alias("stale_leases"))
