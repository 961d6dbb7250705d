"""Lookups, listings and selections over assets, libraries, projects, models and scenes.

Joins carry no broadcast hints: Catalyst broadcasts a side whose size it knows to be small, adaptive
execution switches at run time, and otherwise both sides shuffle with hot keys split.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.paths import has_media_suffix, join_path
from scenelake.operators.ordered import nearest_marks
from scenelake.schemas import (
    HAS_DERIVATIVES, IMAGE_SUFFIXES, MEDIA_SUFFIXES, REANALYSABLE, SEGMENTATION_VERSION,
    VIDEO_SUFFIXES,
)


def require_scope(library: str | None, all_libraries: bool) -> str | None:
    """Exactly one of one library and all libraries must be asked for."""
    if all_libraries == (library is not None):
        raise ValueError("give either one library or all_libraries=True")
    return library


def live_libraries(library: DataFrame) -> DataFrame:
    return library.where(F.col("deleted_at").isNull())


def live_assets(asset: DataFrame, library: DataFrame, slug: str | None = None) -> DataFrame:
    """Assets whose library exists and is not in the trash."""
    keep = live_libraries(library).select(F.col("slug").alias("library_id"))
    if slug is not None:
        asset = asset.where(F.col("library_id") == slug)
    return asset.join(keep, "library_id", "left_semi")


def asset_by_path(asset: DataFrame, library: DataFrame, slug: str, rel_path: str) -> DataFrame:
    return live_assets(asset, library, slug).where(F.col("rel_path") == rel_path)


def asset_by_id(asset: DataFrame, library: DataFrame, asset_id: int) -> DataFrame:
    return live_assets(asset.where(F.col("id") == asset_id), library)


def assets_by_ids(asset: DataFrame, library: DataFrame, ids: DataFrame) -> DataFrame:
    """Live assets whose id is in the `id` column of `ids`; unknown ids are absent."""
    return live_assets(asset.join(ids.select("id"), "id", "left_semi"), library)


def assets_with_library(asset: DataFrame, library: DataFrame) -> DataFrame:
    lib = live_libraries(library).select(F.col("slug").alias("library_id"), "absolute_path")
    return asset.join(lib, "library_id")


# Sort columns per listing order. For `type` the direction applies to the path only.
SORT_COLUMNS = {
    "name": ("rel_path",), "date": ("mtime",), "size": ("size",), "added": ("id",),
    "type": ("type", "rel_path"),
}


def browse(
    asset: DataFrame, library: DataFrame, slug: str, sort_by: str = "date", order: str = "desc",
    types: Iterable[str] | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of a library; ties are broken by id."""
    rows = live_assets(asset, library, slug)
    if types:
        rows = rows.where(F.col("type").isin(list(types)))
    return rows.orderBy(*_ordering(sort_by, order)).offset(offset).limit(limit)


def _ordering(sort_by: str, order: str) -> list[Column]:
    *leading, last = SORT_COLUMNS[sort_by]
    return [*map(F.col, leading), F.col(last).asc() if order == "asc" else F.col(last).desc(), F.col("id")]


def browse_page(
    asset: DataFrame, library: DataFrame, slug: str, sort_by: str = "date", order: str = "desc",
    types: Iterable[str] | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page whose rows tell, in `has_more`, whether another one follows: one row more is fetched and left out.
    The window holds that page only."""
    rows = browse(asset, library, slug, sort_by, order, types, limit + 1, offset)
    place = Window.orderBy(*_ordering(sort_by, order))
    numbered = rows.withColumn("__n", F.row_number().over(place)).withColumn(
        "has_more", F.count("*").over(Window.partitionBy(F.lit(0))) > limit
    )
    return numbered.where(F.col("__n") <= limit).drop("__n")


def assets_of_library(
    asset: DataFrame, slug: str, status: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest first, without regard to the trash."""
    rows = asset.where(F.col("library_id") == slug)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.col("id").desc()).limit(limit) if limit is not None else rows


def completed_after(
    asset: DataFrame, library: DataFrame, cursor: int | None = None, slug: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Completed live assets beyond the cursor, lowest ids first when limited."""
    rows = live_assets(asset.where(F.col("status") == "completed"), library, slug)
    if cursor is not None:
        rows = rows.where(F.col("id") > cursor)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def video_ids(asset: DataFrame, library: DataFrame, slug: str | None = None) -> DataFrame:
    return live_assets(asset.where(F.col("type") == "video"), library, slug).select("id")


def expecting_derivatives(asset: DataFrame, library: DataFrame, slug: str | None = None) -> DataFrame:
    """Assets that should have thumbnails and previews on disk."""
    ready = F.col("status").isin(*HAS_DERIVATIVES) & has_media_suffix(asset, MEDIA_SUFFIXES)
    return live_assets(asset.where(ready), library, slug)


def stale_segmentation(
    asset: DataFrame, library: DataFrame, version: int = SEGMENTATION_VERSION, slug: str | None = None
) -> DataFrame:
    """Segmented videos whose scenes were cut by other rules than the current ones."""
    old = (
        F.col("status").isin(*HAS_DERIVATIVES)
        & (F.col("type") == "video")
        & has_media_suffix(asset, VIDEO_SUFFIXES)
        & (F.col("segmentation_version") != version)
    )
    return live_assets(asset.where(old), library, slug)


def effective_model(target: Column, default_model: int | None) -> Column:
    return F.coalesce(target, F.lit(default_model).cast("bigint"))


def library_models(library: DataFrame, default_model: int | None) -> DataFrame:
    return live_libraries(library).select(
        "slug", effective_model(F.col("target_tagger_id"), default_model).alias("model_id")
    )


def expecting_reanalysis(
    asset: DataFrame, library: DataFrame, default_model: int, slug: str | None = None
) -> DataFrame:
    """Analysed images whose model is not the one their library wants."""
    wanted = library_models(library, default_model).withColumnRenamed("slug", "library_id")
    done = asset.where(
        F.col("status").isin(*REANALYSABLE) & has_media_suffix(asset, IMAGE_SUFFIXES)
    )
    if slug is not None:
        done = done.where(F.col("library_id") == slug)
    return done.join(wanted, "library_id").where(
        ~F.col("analysis_model_id").eqNullSafe(F.col("model_id"))
    )


def eligible_work(
    asset: DataFrame, library: DataFrame, status: str, suffixes: Iterable[str], as_of: int,
    slug: str | None = None, target_model: int | None = None, default_model: int | None = None,
) -> DataFrame:
    """Assets ready for a stage: in its status, or abandoned in processing by an expired lease."""
    expired = (F.col("status") == "processing") & (
        F.col("lease_expires_at") < F.timestamp_seconds(F.lit(as_of))
    )
    rows = asset.where(
        ((F.col("status") == status) | expired) & has_media_suffix(asset, suffixes)
    )
    if target_model is not None and default_model is not None:
        models = library_models(library, default_model).where(F.col("model_id") == target_model)
        rows = rows.join(models.select(F.col("slug").alias("library_id")), "library_id", "left_semi")
    return live_assets(rows, library, slug)


def eligible_metadata(
    asset: DataFrame, library: DataFrame, stage: str, slug: str | None = None
) -> DataFrame:
    """Assets waiting for raw metadata (`exif`) or for sharpness and faces (`sharpness`)."""
    state = F.col("metadata_status")
    waiting = {"exif": state.isNull(), "sharpness": state == "exif_done"}[stage]
    media = has_media_suffix(asset, MEDIA_SUFFIXES)
    return live_assets(asset.where(waiting & media), library, slug)


def latest_models(aimodel: DataFrame) -> DataFrame:
    """Per model name the version registered last."""
    newest = F.max_by("version", "id")
    return aimodel.groupBy("name").agg(F.max("id").alias("id"), newest.alias("version"))


def model_by_name(aimodel: DataFrame, name: str, version: str | None = None) -> DataFrame:
    rows = aimodel.where(F.col("name") == name)
    if version is not None:
        return rows.where(F.col("version") == version)
    return rows.orderBy(F.col("id").desc()).limit(1)


def list_models(aimodel: DataFrame) -> DataFrame:
    return aimodel.orderBy("name", "version")


def model_usage(aimodel: DataFrame, asset: DataFrame) -> DataFrame:
    """Per model name the number of assets analysed by any of its versions.

    Assets are counted per model id before the join, so a model used everywhere is no hot key.
    """
    used = (
        asset.where(F.col("analysis_model_id").isNotNull())
        .groupBy(F.col("analysis_model_id").alias("id")).agg(F.count("*").alias("n"))
    )
    return (
        aimodel.join(used, "id", "left").groupBy("name")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assets"))
    )


def remove_models(aimodel: DataFrame, asset: DataFrame, names: DataFrame) -> DataFrame:
    """Registry without the named models; a model still in use stays."""
    unused = model_usage(aimodel, asset).where(F.col("assets") == 0)
    doomed = unused.join(names.select("name"), "name", "left_semi")
    return aimodel.join(doomed, "name", "left_anti")


def register_models(aimodel: DataFrame, cards: DataFrame) -> DataFrame:
    """Registry with the (name, version) cards it lacks, numbered after the highest id."""
    from scenelake.operators.changes import new_ids

    missing = cards.select("name", "version").distinct().join(aimodel, ["name", "version"], "left_anti")
    numbered = new_ids(missing, ["name", "version"], aimodel.select("id"))
    return aimodel.select("id", "name", "version").unionByName(numbered)


def list_libraries(library: DataFrame, include_deleted: bool = False) -> DataFrame:
    rows = library if include_deleted else live_libraries(library)
    return rows.orderBy("slug")


def trashed_libraries(library: DataFrame) -> DataFrame:
    return library.where(F.col("deleted_at").isNotNull()).orderBy("slug")


def asset_paths(asset: DataFrame, library: DataFrame, project_assets: DataFrame) -> DataFrame:
    """Live assets with a flag telling whether any project holds them."""
    held = project_assets.select(F.col("asset_id").alias("id")).distinct().withColumn("held", F.lit(True))
    return live_assets(asset, library).join(held, "id", "left").select(
        "id", "library_id", "rel_path", F.coalesce("held", F.lit(False)).alias("is_in_project")
    )


def orphan_libraries(asset: DataFrame, library: DataFrame) -> DataFrame:
    """Library ids that assets refer to but no library row has, with their number of assets."""
    counts = asset.groupBy("library_id").agg(F.count("*").alias("assets"))
    return counts.join(library.select(F.col("slug").alias("library_id")), "library_id", "left_anti")


def project_paths(project_assets: DataFrame, asset: DataFrame, library: DataFrame) -> DataFrame:
    """Absolute source path of every project member in a live library."""
    roots = live_libraries(library).select(F.col("slug").alias("library_id"), "absolute_path")
    members = project_assets.join(
        asset.select(F.col("id").alias("asset_id"), "library_id", "rel_path"), "asset_id"
    )
    path = join_path(F.col("absolute_path"), F.col("rel_path"))
    return (
        members.join(roots, "library_id").select("project_id", "asset_id", path.alias("path"))
        .where(F.col("path").isNotNull())
    )


def list_projects(project: DataFrame) -> DataFrame:
    return project.orderBy(F.col("created_at").desc(), F.col("id").desc())


def list_scenes(scene: DataFrame, asset_id: int | None = None) -> DataFrame:
    rows = scene if asset_id is None else scene.where(F.col("asset_id") == asset_id)
    return rows.orderBy("asset_id", "start_ts", "id")


def scene_by_id(scene: DataFrame, scene_id: int) -> DataFrame:
    return scene.where(F.col("id") == scene_id)


def first_scene_frames(scene: DataFrame) -> DataFrame:
    """Per asset the representative frame of its first scene; assets whose path is empty are dropped."""
    first = F.min_by("rep_frame_path", F.struct("start_ts", "id"))
    return (
        scene.groupBy("asset_id").agg(first.alias("rep_frame_path"))
        .where(F.length("rep_frame_path") > 0)
    )


def assets_with_scenes(
    scene: DataFrame, asset: DataFrame, library: DataFrame, slug: str | None = None, limit: int | None = None,
    offset: int = 0, after: int | None = None,
) -> DataFrame:
    """Live assets with at least one scene: all, or with `limit` one page by id. `after` goes on behind an id, which
    reads no page again; `offset` counts from there."""
    having = scene.select(F.col("asset_id").alias("id"))
    rows = live_assets(asset, library, slug)
    if after is not None:
        having, rows = having.where(F.col("id") > after), rows.where(F.col("id") > after)
    found = rows.join(having.distinct(), "id", "left_semi").select("id", "library_id")
    if limit is None and not offset:
        return found
    page = found.orderBy("id").offset(offset)
    return page if limit is None else page.limit(limit)


def scene_progress(scene: DataFrame) -> DataFrame:
    """Per asset how far it is indexed and the description of its last scene."""
    return scene.groupBy("asset_id").agg(
        F.max("end_ts").alias("max_end_ts"),
        F.max_by("description", F.struct("end_ts", "id")).alias("last_description"),
    )


def nearest_scene(
    scene: DataFrame, moments: DataFrame, chunk_seconds: float = 3600.0
) -> DataFrame:
    """For each (asset_id, ts) the analysed scene starting closest to it; ties go to the earlier one.

    Scenes and moments are merged on one time line and the closest scene before and after is carried
    along it, so nothing is paired within an asset and a long video spreads over many tasks.
    """
    marks = scene.where(F.col("metadata").isNotNull()).select(
        "asset_id", F.col("start_ts").alias("t"), F.lit(None).cast("double").alias("ts"),
        F.col("id").alias("scene_id"),
    )
    asked = moments.select("asset_id", "ts").where(F.col("ts").isNotNull()).distinct().select(
        "asset_id", F.col("ts").alias("t"), "ts", F.lit(None).cast("bigint").alias("scene_id")
    )
    line = marks.unionByName(asked)
    is_moment = F.col("ts").isNotNull()
    line = nearest_marks(line, ["asset_id"], F.col("t"), F.col("scene_id"), chunk_seconds)
    gap_before, gap_after = F.col("ts") - F.col("before.at"), -F.col("after.at") - F.col("ts")
    later = F.col("before").isNull() | (gap_after < gap_before)
    chosen = F.when(later, -F.col("after.neg_id")).otherwise(-F.col("before.neg_id"))
    answers = line.where(is_moment).select("asset_id", "ts", chosen.alias("scene_id"))
    found = scene.select(
        F.col("id").alias("scene_id"), "start_ts", F.col("metadata.analysis").alias("analysis")
    )
    return answers.join(found, "scene_id").select("asset_id", "ts", "scene_id", "start_ts", "analysis")


def asset_detail(asset: DataFrame, library: DataFrame, scene: DataFrame, moments: DataFrame) -> DataFrame:
    """Description, tags and text of assets; a video asked for at a time answers with its nearest scene."""
    timed = moments.where(F.col("ts").isNotNull())
    near = nearest_scene(scene, timed).select("asset_id", "ts", "analysis")
    rows = (
        live_assets(asset, library).withColumnRenamed("id", "asset_id").join(moments, "asset_id")
        .join(near.withColumnRenamed("ts", "at").withColumnRenamed("asset_id", "near_id"),
              (F.col("asset_id") == F.col("near_id")) & (F.col("ts") == F.col("at"))
              & (F.col("type") == "video"), "left")
    )

    def pick(field: str) -> Column:
        own = F.col("visual_analysis")[field]
        return F.when(F.col("analysis").isNotNull(), F.col("analysis")[field]).otherwise(own)

    return rows.select(
        "asset_id", "ts", pick("description").alias("description"),
        F.coalesce(pick("tags"), F.array().cast("array<string>")).alias("tags"),
        pick("ocr_text").alias("ocr_text"), F.col("library_id").alias("library_slug"),
        F.substring_index("rel_path", "/", -1).alias("filename"),
    )
