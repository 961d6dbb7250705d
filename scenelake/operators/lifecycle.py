"""Libraries, projects, model policies, and deletes that cascade."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.paths import base_name, slugify, stem_and_ext
from scenelake.operators.catalog import orphan_libraries, project_paths, video_ids
from scenelake.operators.changes import apply_status, new_ids
from scenelake.operators.ordered import row_numbers, running
from scenelake.session import cut_lineage


def _set(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.select(
        *[
            F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in table.columns
        ]
    )


# Libraries ------------------------------------------------------------------------------------


def set_trash(library: DataFrame, slugs: Iterable[str], as_of: int | None) -> DataFrame:
    """Move libraries to the trash at `as_of`, or restore them when it is None."""
    stamp = F.timestamp_seconds(F.lit(as_of)) if as_of is not None else F.lit(None).cast("timestamp")
    return _set(library, F.col("slug").isin(list(slugs)), {"deleted_at": stamp})


def add_libraries(library: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add (name, absolute_path) requests; returns the new table and the rejected requests.

    A request is rejected when its slug is taken, with a message that tells active from trashed.
    """
    asked = requests.withColumn("slug", slugify(F.col("name")))
    taken = library.select("slug", F.col("deleted_at").isNotNull().alias("trashed"), F.lit(True).alias("hit"))
    checked = asked.join(taken, "slug", "left")
    reason = F.when(
        F.col("trashed"), "a library with this slug is in the trash; restore it or choose another name"
    ).otherwise("an active library with this slug exists")
    rejected = checked.where(F.col("hit").isNotNull()).select("name", "slug", reason.alias("reason"))
    values = {
        "is_active": F.lit(True), "scan_status": F.lit("idle"),
        "sampling_limit": F.lit(100).cast("bigint"),
    }
    fresh = checked.where(F.col("hit").isNull()).groupBy("slug").agg(
        F.min_by("name", "name").alias("name"), F.min_by("absolute_path", "name").alias("absolute_path")
    )
    added = fresh.select(
        *[
            F.col(f.name) if f.name in fresh.columns
            else values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in library.schema.fields
        ]
    )
    return library.unionByName(added), rejected


def set_scan_status(library: DataFrame, slug: str, status: str) -> DataFrame:
    return _set(library, F.col("slug") == slug, {"scan_status": F.lit(status)})


def scannable(library: DataFrame) -> DataFrame:
    """Active live libraries for which a scan was requested."""
    return library.where(
        F.col("is_active") & F.col("deleted_at").isNull()
        & F.col("scan_status").isin("full_scan_requested", "fast_scan_requested")
    )


# Cascades --------------------------------------------------------------------------------------


def without_assets(doomed: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables (`asset` and any children) without the asset ids in `doomed` (column `id`).

    One anti join per table on the asset id, which is unique in the asset table, so no key is hot
    except through its own child rows, and those stay on the streamed side.
    """
    gone = doomed.select(F.col("id").alias("asset_id"))
    out = {}
    for name, table in tables.items():
        key = "id" if name == "asset" else "asset_id"
        out[name] = table.join(gone.withColumnRenamed("asset_id", key), key, "left_anti")
    return out


def hard_delete(
    library: DataFrame, policy: DataFrame, tables: dict[str, DataFrame], slug: str | None = None
) -> dict[str, DataFrame]:
    """Remove trashed libraries (all, or one) with their assets, scenes, states, frames and policy."""
    trashed = library.where(F.col("deleted_at").isNotNull())
    if slug is not None:
        trashed = trashed.where(F.col("slug") == slug)
    slugs = trashed.select(F.col("slug").alias("library_id"))
    out = without_assets(tables["asset"].join(slugs, "library_id", "left_semi"), tables)
    out["library"] = library.join(trashed.select("slug"), "slug", "left_anti")
    out["policy"] = policy.join(trashed.select(F.col("slug").alias("library_slug")), "library_slug", "left_anti")
    return out


def require_trashed(library: DataFrame, slug: str) -> None:
    """Raise unless the library exists and is in the trash."""
    row = library.where(F.col("slug") == slug).select("deleted_at").first()
    if row is None:
        raise ValueError(f"no library {slug!r}")
    if row[0] is None:
        raise ValueError(f"library {slug!r} is not in the trash")


def purged_folders(library: DataFrame) -> DataFrame:
    """Data folders that vanish with the trashed libraries."""
    slug = F.col("slug")
    folders = F.array(
        slug, F.concat(F.lit("tmp/"), slug), F.concat(F.lit("video_clips/"), slug),
        F.concat(F.lit("video_scenes/"), slug),
    )
    return library.where(F.col("deleted_at").isNotNull()).select("slug", F.explode(folders).alias("folder"))


def delete_orphans(library: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove assets, with their children, whose library has no row."""
    lost = orphan_libraries(tables["asset"], library).select("library_id")
    return without_assets(tables["asset"].join(lost, "library_id", "left_semi"), tables)


def delete_assets(
    ids: DataFrame, project_assets: DataFrame, tables: dict[str, DataFrame]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cascade-delete asset ids; those held by a project are refused and returned."""
    held = project_assets.select(F.col("asset_id").alias("id")).distinct()
    allowed = ids.join(held, "id", "left_anti")
    return without_assets(allowed, tables), ids.join(held, "id", "left_semi")


def reindex_videos(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Drop scenes and open states of videos, clear their preview and put them back to pending."""
    gone = ids.select(F.col("id").alias("asset_id"))
    out = {
        name: table.join(gone, "asset_id", "left_anti")
        for name, table in tables.items() if name != "asset"
    }
    pending = ids.select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_message"))
    out["asset"] = apply_status(tables["asset"], pending, clear=("preview_path",))
    return out


def reindex_library(library: DataFrame, tables: dict[str, DataFrame], slug: str) -> dict[str, DataFrame]:
    return reindex_videos(video_ids(tables["asset"], library, slug), tables)


# Projects --------------------------------------------------------------------------------------


def create_projects(project: DataFrame, requests: DataFrame, as_of: int) -> DataFrame:
    """Append (name, export_path) requests with a non-empty name."""
    named = requests.select(F.trim("name").alias("name"), "export_path").where(F.length("name") > 0)
    fresh = new_ids(named, ["name"], project.select("id"))
    return project.unionByName(
        fresh.withColumn("created_at", F.timestamp_seconds(F.lit(as_of))).select(*project.columns)
    )


def add_to_projects(
    project_assets: DataFrame, additions: DataFrame, project: DataFrame, live: DataFrame
) -> DataFrame:
    """Membership with the additions; repeats and unknown projects or assets change nothing."""
    known = additions.select("project_id", "asset_id").join(
        project.select(F.col("id").alias("project_id")), "project_id", "left_semi"
    ).join(live.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return project_assets.unionByName(known).distinct()


def remove_from_projects(project_assets: DataFrame, removals: DataFrame) -> DataFrame:
    return project_assets.join(removals, ["project_id", "asset_id"], "left_anti")


def export_manifest(project_assets: DataFrame, asset: DataFrame, library: DataFrame) -> DataFrame:
    """Source path and collision-free file name of every project member.

    The first file of a name (lowest asset id) keeps it. Repeats become `stem_2.ext`, `stem_3.ext`,
    ..., leaving out numbers that some file of the project carries literally. Names made from
    different stems cannot meet, so each (project, name) is settled on its own, in chunks.
    """
    files = project_paths(project_assets, asset, library).withColumn("name", base_name(F.col("path")))
    files = files.where(F.length("name") > 0)
    # Three branches below start from the numbered files.
    files = cut_lineage(row_numbers(files, ["project_id", "name"], "asset_id", "copy"))
    stem, ext = stem_and_ext(F.col("name"))
    repeats = files.where(F.col("copy") > 1).withColumn("slot", F.col("copy") - 1)

    # Literal names `stem_N.ext` occupy number N of `stem.ext`, when that name repeats at all.
    # The i-th occupied number N leaves N - 1 - i free numbers below it; slots above that shift by i.
    pattern = r"^(.+)_([1-9]\d{0,17})$"
    literal = files.where(F.col("copy") == 1).select(
        "project_id",
        F.concat(F.regexp_extract(stem, pattern, 1), ext).alias("name"),
        F.regexp_extract(stem, pattern, 2).try_cast("bigint").alias("number"),
    ).where(F.col("number") >= 2)
    wanted = repeats.select("project_id", "name").distinct()
    occupied = row_numbers(
        literal.join(wanted, ["project_id", "name"], "left_semi"), ["project_id", "name"], "number", "i"
    )
    steps = occupied.groupBy("project_id", "name", (F.col("number") - 1 - F.col("i")).alias("below")).agg(
        F.max("i").alias("shift")
    )
    none = F.lit(None)
    line = repeats.select(
        "project_id", "asset_id", "path", "name", F.col("slot").alias("at"), none.cast("bigint").alias("shift")
    ).unionByName(
        steps.select(
            "project_id", none.cast("bigint").alias("asset_id"), none.cast("string").alias("path"),
            "name", (F.col("below") + 1).alias("at"), "shift",
        )
    )
    order = [F.col("at"), F.col("shift").isNull()]
    shifted = running(
        line, ["project_id", "name"], F.col("at"), order, F.col("shift"), "total", 100_000, how=F.max
    ).where(F.col("asset_id").isNotNull())
    number = F.col("at") + 1 + F.coalesce("total", F.lit(0))
    renamed = shifted.select(
        "project_id", "asset_id", "path",
        F.concat(stem, F.lit("_"), number.cast("string"), ext).alias("dest_name"),
    )
    first = files.where(F.col("copy") == 1).select(
        "project_id", "asset_id", "path", F.col("name").alias("dest_name")
    )
    return first.unionByName(renamed)


# Model policies --------------------------------------------------------------------------------


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def begin_shadow(policy: DataFrame, slug: str, index_name: str, as_of: int) -> DataFrame:
    """Start filling a shadow index; the library is locked to its active one."""
    return _set(policy, F.col("library_slug") == slug, {
        "shadow_index_name": F.lit(index_name), "locked": F.lit(True),
        "locked_since": F.timestamp_seconds(F.lit(as_of)), "promotion_progress": F.lit(0.0),
    })


def set_progress(policy: DataFrame, slug: str, progress: float) -> DataFrame:
    value = F.lit(max(0.0, min(1.0, progress)))
    return _set(policy, F.col("library_slug") == slug, {"promotion_progress": value})


def promote(policy: DataFrame, condition: Column | None = None, index_name: str | None = None) -> DataFrame:
    """Shadow (or the named index) becomes active, active becomes previous, the lock ends."""
    shadow = F.lit(index_name) if index_name is not None else F.col("shadow_index_name")
    which = condition if condition is not None else F.col("shadow_index_name").isNotNull()
    return _set(policy, which, {
        "previous_index_name": F.col("active_index_name"), "active_index_name": shadow,
        "shadow_index_name": _null("string"), "locked": F.lit(False),
        "locked_since": _null("timestamp"), "promotion_progress": F.lit(1.0),
    })


def rollback(policy: DataFrame, condition: Column | None = None) -> DataFrame:
    """Previous becomes active and active is kept as shadow, where there is a previous index."""
    which = F.col("previous_index_name").isNotNull()
    which = which if condition is None else which & condition
    return _set(policy, which, {
        "shadow_index_name": F.col("active_index_name"),
        "active_index_name": F.col("previous_index_name"),
        "previous_index_name": _null("string"), "locked": F.lit(False),
        "locked_since": _null("timestamp"), "promotion_progress": F.lit(1.0),
    })


def rollback_library(policy: DataFrame, slug: str) -> DataFrame:
    """Roll one library back; raises when it has nothing to go back to."""
    row = policy.where(F.col("library_slug") == slug).select("previous_index_name").first()
    if row is None or row[0] is None:
        raise ValueError(f"library {slug!r} has no previous index")
    return rollback(policy, F.col("library_slug") == slug)


def upsert_policies(policy: DataFrame, rows: DataFrame) -> DataFrame:
    kept = policy.join(rows.select("library_slug"), "library_slug", "left_anti")
    return kept.unionByName(rows.select(*policy.columns))


def delete_policies(policy: DataFrame, slugs: Iterable[str]) -> DataFrame:
    return policy.where(~F.col("library_slug").isin(list(slugs)))


def first_policies(policy: DataFrame, libraries: DataFrame, as_of: int) -> DataFrame:
    """Policy table completed with a first index for every library (column `library_slug`) lacking one."""
    missing = libraries.select("library_slug").distinct().join(policy, "library_slug", "left_anti")
    name = F.concat(F.lit("media_scenes_"), F.col("library_slug"), F.lit(f"_{as_of}"))
    values = {
        "active_index_name": name, "locked": F.lit(False), "promotion_progress": F.lit(0.0),
    }
    added = missing.select(
        *[
            F.col(f.name) if f.name == "library_slug"
            else values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in policy.schema.fields
        ]
    )
    return policy.unionByName(added)
