"""Row changes as pure functions from a table and its changes to the next snapshot.

Nothing is updated in place: the caller writes the result to a new snapshot directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.exif import media_metadata
from scenelake.functions.paths import suffix
from scenelake.schemas import MAX_RETRIES, MEDIA_METADATA

_ID_BUCKETS = 4096


def new_ids(rows: DataFrame, key: list[str], existing: DataFrame) -> DataFrame:
    """Give rows with a unique key dense ids after the highest existing one.

    Rows are numbered inside hash buckets of their key and shifted by the sizes of earlier buckets,
    so the result depends only on the data and no task sees more than one bucket.
    """
    digest = F.md5(F.concat_ws("/", *key))
    bucket = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    placed = rows.withColumn("__bucket", bucket % _ID_BUCKETS)
    sizes = placed.groupBy("__bucket").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(*key))
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    return placed.withColumn("__n", number).join(shifts, "__bucket").select(
        (highest + F.col("shift") + F.col("__n")).cast("bigint").alias("id"), *rows.columns
    )


def scan_diff(asset: DataFrame, found: DataFrame) -> DataFrame:
    """State of every scanned file against the catalog: new, changed or unchanged."""
    old = asset.select(
        "library_id", "rel_path", "id", F.col("type").alias("old_type"),
        F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"),
    )
    moved = ~(F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size")))
    return found.join(old, ["library_id", "rel_path"], "left").withColumn(
        "change", F.when(F.col("id").isNull(), "new").when(moved, "changed").otherwise("unchanged")
    )


def changed_videos(asset: DataFrame, found: DataFrame) -> DataFrame:
    """Ids of known videos whose file differs: their scenes no longer describe the content."""
    diff = scan_diff(asset, found)
    return diff.where((F.col("change") == "changed") & (F.col("old_type") == "video")).select("id")


def scan_upsert(asset: DataFrame, found: DataFrame) -> DataFrame:
    """Asset table after a scan.

    New files become pending; a changed modification time or size puts the asset back to pending and
    takes it from its worker; assets that were not seen stay.
    """
    key = ["library_id", "rel_path"]
    seen = found.select(
        *key, F.col("type").alias("f_type"), F.col("mtime").alias("f_mtime"),
        F.col("size").alias("f_size"), F.lit(True).alias("f_seen"),
    )
    both = asset.join(seen, key, "left")
    is_seen = F.col("f_seen").isNotNull()
    same = F.col("mtime").eqNullSafe(F.col("f_mtime")) & F.col("size").eqNullSafe(F.col("f_size"))
    changed = is_seen & ~same
    was_video = changed & (F.col("type") == "video")
    rules: dict[str, Column] = {
        "type": F.when(is_seen, F.col("f_type")).otherwise(F.col("type")),
        "mtime": F.when(is_seen, F.col("f_mtime")).otherwise(F.col("mtime")),
        "size": F.when(is_seen, F.col("f_size")).otherwise(F.col("size")),
        "status": F.when(changed, "pending").otherwise(F.col("status")),
        **{c: F.when(~changed, F.col(c)) for c in ("tags_model_id", "worker_id", "lease_expires_at")},
        **{c: F.when(~was_video, F.col(c)) for c in ("preview_path", "video_preview_path")},
    }
    kept = both.select(*[rules.get(c, F.col(c)).alias(c) for c in asset.columns])
    fresh = new_ids(found.join(asset.select(*key), key, "left_anti"), key, asset.select("id"))
    values = {
        "status": F.lit("pending"), "retry_count": F.lit(0).cast("bigint"),
        "ext": suffix(F.col("rel_path")).alias("ext"),
    }
    added = fresh.select(
        *[
            F.col(f.name) if f.name in fresh.columns and f.name != "ext"
            else values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in asset.schema.fields
        ]
    )
    return kept.unionByName(added)


def _updated(asset: DataFrame, changes: DataFrame, rules: dict[str, Column], applies: Column) -> DataFrame:
    """Left-join changes (columns prefixed `n_`, one row per id) and apply the rules where they hold."""
    joined = asset.join(changes, "id", "left")
    return joined.select(
        *[
            F.when(applies, rules[c]).otherwise(F.col(c)).alias(c) if c in rules else F.col(c)
            for c in asset.columns
        ]
    )


def retries_after(status: Column, retries: Column) -> Column:
    return (
        F.when(status.isin("failed", "poisoned"), retries + 1)
        .when(status.isin("proxied", "analyzed_light", "completed"), F.lit(0).cast("bigint"))
        .otherwise(retries)
    )


def apply_status(
    asset: DataFrame, changes: DataFrame, check_owner: bool = False, clear: tuple[str, ...] = ()
) -> DataFrame:
    """Set status and error of the ids in `changes` (id, status, error_message[, owner]).

    The lease ends and retries are counted or cleared; columns in `clear` become null. With
    `check_owner` a change counts only while the asset still belongs to that owner.
    """
    extra = [F.col("owner").alias("n_owner")] if check_owner else []
    new = changes.select(
        "id", F.col("status").alias("n_status"), F.col("error_message").alias("n_error"), *extra
    )
    applies = F.col("n_status").isNotNull()
    if check_owner:
        applies = applies & (F.col("worker_id") == F.col("n_owner"))
    rules = {
        "status": F.col("n_status"),
        "worker_id": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
        "error_message": F.col("n_error"),
        "retry_count": retries_after(F.col("n_status"), F.col("retry_count")),
        **{c: F.lit(None).cast(asset.schema[c].dataType) for c in clear},
    }
    return _updated(asset, new, rules, applies)


def finish_analysis(asset: DataFrame, done: DataFrame, status: str) -> DataFrame:
    """Mark owned assets `analyzed_light` or `completed` with the model that did it (id, model_id, owner)."""
    new = done.select("id", F.col("model_id").alias("n_model"), F.col("owner").alias("n_owner"))
    rules = {
        "status": F.lit(status),
        "analysis_model_id": F.col("n_model"),
        "worker_id": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
        "retry_count": F.lit(0).cast("bigint"),
    }
    return _updated(asset, new, rules, F.col("worker_id") == F.col("n_owner"))


def _expired(as_of: int) -> Column:
    return (F.col("status") == "processing") & (
        F.col("lease_expires_at") < F.timestamp_seconds(F.lit(as_of))
    )


def _where(asset: DataFrame, condition: Column, slug: str | None, rules: dict[str, Column]) -> DataFrame:
    if slug is not None:
        condition = condition & (F.col("library_id") == slug)
    return asset.select(
        *[
            F.when(condition, rules[c]).otherwise(F.col(c)).alias(c) if c in rules else F.col(c)
            for c in asset.columns
        ]
    )


def reclaim_leases(asset: DataFrame, as_of: int, slug: str | None = None) -> DataFrame:
    """Take back assets whose lease ran out; one retried too often is poisoned."""
    spent = F.col("retry_count") > MAX_RETRIES
    rules = {
        "status": F.when(spent, "poisoned").otherwise("pending"),
        "worker_id": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
        "retry_count": F.when(spent, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "error_message": F.when(spent, "lease ran out too often").otherwise(F.col("error_message")),
    }
    return _where(asset, _expired(as_of), slug, rules)


def reset_poisoned(asset: DataFrame, slug: str | None = None) -> DataFrame:
    rules = {
        "status": F.lit("pending"),
        "retry_count": F.lit(0).cast("bigint"),
        "error_message": F.lit(None).cast("string"),
    }
    return _where(asset, F.col("status") == "poisoned", slug, rules)


def reset_stuck_metadata(asset: DataFrame, older_than_seconds: float, as_of: int) -> DataFrame:
    """Step back metadata work that never finished; age is judged by the file's own time."""
    if older_than_seconds <= 0:
        return asset
    old = F.col("mtime") < F.lit(float(as_of - older_than_seconds))
    state = F.col("metadata_status")
    back = (
        F.when(old & (state == "sharpness_processing"), "exif_done")
        .when(old & (state == "exif_processing"), F.lit(None).cast("string"))
        .otherwise(state)
    )
    return asset.withColumn("metadata_status", back)


def return_to_exif_done(asset: DataFrame, ids: DataFrame) -> DataFrame:
    """Single-asset form of the above, for assets without a thumbnail to measure."""
    new = ids.select("id", F.lit(True).alias("n_hit"))
    applies = F.col("n_hit").isNotNull() & (F.col("metadata_status") == "sharpness_processing")
    return _updated(asset, new, {"metadata_status": F.lit("exif_done")}, applies)


def write_exif(asset: DataFrame, results: DataFrame) -> DataFrame:
    """Store raw and normalised metadata (id, raw_exif[, place struct]) and move on to `exif_done`."""
    place = F.col("n_place") if "place" in results.columns else None
    new = results.select(
        "id", F.col("raw_exif").alias("n_raw"),
        *([F.col("place").alias("n_place")] if place is not None else []),
    )
    fresh = media_metadata(F.col("n_raw"), F.col("type"), F.col("mtime"), place)
    fields = [
        (fresh[f.name] if f.name not in ("has_face", "face_count", "sharpness_score")
         else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in MEDIA_METADATA.fields
    ]
    rules = {
        "raw_exif": F.col("n_raw"),
        "media_metadata": F.struct(*fields),
        "metadata_status": F.lit("exif_done"),
    }
    return _updated(asset, new, rules, F.col("n_raw").isNotNull())


def merge_sharpness(asset: DataFrame, results: DataFrame) -> DataFrame:
    """Merge (id, has_face, face_count, sharpness_score) into the metadata of assets being measured."""
    names = ("has_face", "face_count", "sharpness_score")
    new = results.select("id", *[F.col(n).alias("n_" + n) for n in names], F.lit(True).alias("n_hit"))
    kinds = {f.name: f.dataType for f in MEDIA_METADATA.fields}
    merged = F.struct(
        *[
            (F.col("n_" + n) if n in names else F.col("media_metadata")[n]).cast(kinds[n]).alias(n)
            for n in kinds
        ]
    )
    applies = F.col("n_hit").isNotNull() & (F.col("metadata_status") == "sharpness_processing")
    rules = {"media_metadata": merged, "metadata_status": F.lit("complete")}
    return _updated(asset, new, rules, applies)


def _analysis_struct(asset: DataFrame, values: dict[str, Column]) -> Column:
    kind = asset.schema["visual_analysis"].dataType
    return F.struct(
        *[
            values.get(f.name, F.col("visual_analysis")[f.name]).cast(f.dataType).alias(f.name)
            for f in kind.fields
        ]
    )


def save_analysis(asset: DataFrame, results: DataFrame) -> DataFrame:
    """Replace the analysis of assets (id, description, tags, ocr_text, model_name, model_version)."""
    names = ("description", "tags", "ocr_text", "model_name", "model_version")
    new = results.select("id", *[F.col(n).alias("n_" + n) for n in names], F.lit(True).alias("n_hit"))
    whole = _analysis_struct(asset, {n: F.col("n_" + n) for n in names})
    return _updated(asset, new, {"visual_analysis": whole}, F.col("n_hit").isNotNull())


def merge_ocr(asset: DataFrame, results: DataFrame) -> DataFrame:
    """Set only the text of the analysis (id, ocr_text); an absent analysis starts empty."""
    new = results.select("id", F.col("ocr_text").alias("n_ocr"), F.lit(True).alias("n_hit"))
    merged = _analysis_struct(asset, {"ocr_text": F.col("n_ocr")})
    return _updated(asset, new, {"visual_analysis": merged}, F.col("n_hit").isNotNull())


def apply_attributes(asset: DataFrame, updates: DataFrame) -> DataFrame:
    """Set any of the columns `updates` carries next to `id`; a null value clears."""
    names = [c for c in updates.columns if c != "id"]
    new = updates.select("id", *[F.col(n).alias("n_" + n) for n in names], F.lit(True).alias("n_hit"))
    rules = {n: F.col("n_" + n) for n in names}
    return _updated(asset, new, rules, F.col("n_hit").isNotNull())


# Error classes that decide the state after a failed stage.
TRANSIENT, PERMANENT, OTHER = "transient", "permanent", "other"


def status_after_failure(
    stage: Column, error_class: Column, claimed_from: Column, retries: Column
) -> Column:
    """Next status of a failed asset.

    A transient error of the analysis stages gives the asset back; a permanent one poisons it; image
    analysis never retries; every other stage fails until the retries are used up.
    """
    analysing = stage.isin("image_analysis", "video_analysis")
    return (
        F.when((error_class == TRANSIENT) & analysing, claimed_from)
        .when((error_class == PERMANENT) | (stage == "image_analysis"), F.lit("poisoned"))
        .when(retries > MAX_RETRIES, "poisoned")
        .otherwise("failed")
    )


def error_after_failure(stage: Column, error_class: Column, message: Column, retries: Column) -> Column:
    """Stored message: none for a transient error, a note when a video ran out of retries."""
    note = F.concat(
        message, F.lit("\n\ngave up after too many tries ("), retries.cast("string"),
        F.lit(f" > {MAX_RETRIES})"),
    )
    transient = (error_class == TRANSIENT) & stage.isin("image_analysis", "video_analysis")
    spent = (stage == "video_proxy") & (error_class != PERMANENT) & (retries > MAX_RETRIES)
    return F.when(~transient, F.when(spent, note).otherwise(message))
