"""What is on disk against what the catalog expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.paths import (
    escapes_root, head_clip_path, proxy_path, thumbnail_path,
)
from scenelake.operators.catalog import (
    asset_paths, expecting_derivatives, live_assets, live_libraries, stale_segmentation,
)

DURATION_TOLERANCE_SECONDS = 2.0
DURATION_TOLERANCE_SHARE = 0.02


def _referenced_paths(asset: DataFrame, scene: DataFrame, library: DataFrame) -> DataFrame:
    library_id, asset_id = F.col("library_id"), F.col("id")
    stills = expecting_derivatives(asset, library).select(
        F.explode(F.array(thumbnail_path(library_id, asset_id), proxy_path(library_id, asset_id))).alias("path")
    )
    live = live_assets(asset, library)
    clips = live.where(F.length("video_preview_path") > 0).select(F.col("video_preview_path").alias("path"))
    frames = (
        scene.where(F.length("rep_frame_path") > 0)
        .join(live.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
        .select(F.col("rep_frame_path").alias("path"))
    )
    return stills.unionByName(clips).unionByName(frames)


def expected_paths(asset: DataFrame, scene: DataFrame, library: DataFrame) -> DataFrame:
    """Relative paths of every derivative the live catalog refers to."""
    return _referenced_paths(asset, scene, library).distinct()


def orphan_files(
    files: DataFrame, asset: DataFrame, scene: DataFrame, library: DataFrame, min_age_seconds: float,
    as_of: int,
) -> DataFrame:
    """Old enough files in the folders of live libraries that nothing in the catalog refers to."""
    part = F.split("path", "/")
    shared = part[0].isin("video_clips", "video_scenes")
    owner = F.when(shared, part[1]).when(part[1].isin("thumbnails", "proxies"), part[0])
    old = files.where(F.col("mtime") < F.lit(float(as_of - min_age_seconds))).withColumn("slug", owner)
    return (
        old.join(live_libraries(library).select("slug"), "slug", "left_semi").drop("slug")
        .join(_referenced_paths(asset, scene, library), "path", "left_anti")
    )


def temp_files(files: DataFrame, max_age_seconds: float, as_of: int, slug: str | None = None) -> DataFrame:
    """Temporary files past their age, in one library's folder or in all."""
    folder = "tmp/" if slug is None else f"tmp/{slug}/"
    old = F.col("mtime") < F.lit(float(as_of - max_age_seconds))
    return files.where(F.startswith(F.col("path"), F.lit(folder)) & old)


def file_totals(files: DataFrame) -> DataFrame:
    """Preview of a clean-up: how many files and bytes would go."""
    return files.agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")
    )


def missing_sources(
    asset: DataFrame, library: DataFrame, project_assets: DataFrame, source_files: DataFrame,
    unreadable: DataFrame | None = None,
) -> DataFrame:
    """Live assets whose file is gone or lies outside its library; project members are protected.

    `unreadable` (library_id, path) are folders that the inventory could not list: assets below them are not
    known to be gone and are left out. An empty path is the root, hence the whole library.
    """
    roots = live_libraries(library).select(F.col("slug").alias("library_id"), "absolute_path")
    known = asset_paths(asset, library, project_assets).join(roots, "library_id")
    present = source_files.select("library_id", "rel_path", F.lit(True).alias("present"))
    checked = known.join(present, ["library_id", "rel_path"], "left")
    outside = escapes_root(F.col("absolute_path"), F.col("rel_path"))
    gone = checked.where(F.col("present").isNull() | outside)
    if unreadable is not None:
        parts = F.split("rel_path", "/")
        above = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
        )
        closed = unreadable.select("library_id", F.col("path").alias("folder"))
        hidden = gone.withColumn("folder", F.explode(above)).join(closed, ["library_id", "folder"], "left_semi")
        gone = gone.join(hidden.select("id"), "id", "left_anti")
    return gone.select("id", "library_id", "rel_path", F.col("is_in_project").alias("protected"))


def missing_derivatives(asset: DataFrame, library: DataFrame, files: DataFrame) -> DataFrame:
    """Assets lacking a non-empty thumbnail, or proxy (image) or head clip (video).

    Each asset asks for its two paths; one anti join finds the absent ones.
    """
    library_id, asset_id = F.col("library_id"), F.col("id")
    second = F.when(F.col("type") == "image", proxy_path(library_id, asset_id)).otherwise(
        head_clip_path(library_id, asset_id)
    )
    asked = expecting_derivatives(asset, library).select(
        "id", "library_id", "type",
        F.explode(
            F.array(
                F.struct(F.lit("thumbnail").alias("kind"), thumbnail_path(library_id, asset_id).alias("path")),
                F.struct(F.lit("preview").alias("kind"), second.alias("path")),
            )
        ).alias("want"),
    ).select("id", "library_id", "type", "want.*")
    filled = files.where(F.col("size") > 0).select("path")
    return asked.join(filled, "path", "left_anti").groupBy("id", "library_id", "type").agg(
        F.bool_or(F.col("kind") == "thumbnail").alias("no_thumbnail"),
        F.bool_or(F.col("kind") == "preview").alias("no_preview"),
    )


def missing_head_clip_paths(asset: DataFrame, files: DataFrame) -> DataFrame:
    """Updates (id, video_preview_path) for videos whose head clip exists but is not recorded."""
    clip = head_clip_path(F.col("library_id"), F.col("id"))
    blank = asset.where((F.col("type") == "video") & (F.length(F.coalesce("video_preview_path", F.lit(""))) == 0))
    filled = files.where(F.col("size") > 0).select(F.col("path").alias("video_preview_path"))
    return blank.select("id", clip.alias("video_preview_path")).join(filled, "video_preview_path", "left_semi")


def resegmentable(
    asset: DataFrame, library: DataFrame, source_files: DataFrame, slug: str | None = None
) -> DataFrame:
    """Videos cut by outdated rules whose source is still there."""
    present = source_files.select("library_id", "rel_path")
    return stale_segmentation(asset, library, slug=slug).join(
        present, ["library_id", "rel_path"], "left_semi"
    ).select("id")


def truncated_indexes(scene: DataFrame, durations: DataFrame) -> DataFrame:
    """Videos (asset_id, duration_sec) whose scenes stop clearly before the end."""
    ends = scene.groupBy("asset_id").agg(F.max("end_ts").alias("indexed_to"))
    slack = F.least(F.lit(DURATION_TOLERANCE_SECONDS), F.col("duration_sec") * DURATION_TOLERANCE_SHARE)
    return durations.join(ends, "asset_id").where(F.col("indexed_to") < F.col("duration_sec") - slack)
