"""Record dumps and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, json): the full record of every row, nulls included."""
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(key, record.alias("json"))


def asset_summary(asset: DataFrame) -> DataFrame:
    """Short listing of assets, size in whole kilobytes."""
    return asset.select(
        "id", "library_id", "rel_path", "type", "status",
        F.bround(F.coalesce("size", F.lit(0)) / 1024).cast("bigint").alias("size_kb"),
    )


def clip_description(text: Column, width: int = 60) -> Column:
    """One-line description for a listing, shortened with dots."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    short = F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))).otherwise(line)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("—"))


def write_manifest(manifest: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an export manifest; CSV gets a header."""
    manifest.write.mode("errorifexists").option("header", True).format(fmt).save(path)
