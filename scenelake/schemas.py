"""Table schemas, value sets and constants of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _table(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


VISUAL_ANALYSIS = _table(
    description=_S, tags=T.ArrayType(_S), ocr_text=_S, model_name=_S, model_version=_S
)
# `ocr_done` keeps "OCR ran and found nothing" apart from "OCR has not run".
SCENE_ANALYSIS = _table(description=_S, tags=T.ArrayType(_S), ocr_text=_S, ocr_done=_B)
SCENE_METADATA = _table(analysis=SCENE_ANALYSIS, showinfo=_S, semantic_duplicate=_B)
MEDIA_METADATA = _table(
    metadata_version=T.IntegerType(), capture_ts=_D, capture_ts_source=_S, camera_make=_S,
    camera_model=_S, color_space=_S, generation_hint=_S, gps_lat=_D, gps_lon=_D, country=_S,
    region=_S, city=_S, resolution_w=_L, resolution_h=_L, duration_sec=_D, frame_rate=_D,
    has_face=_B, face_count=_L, sharpness_score=_D,
)
AIMODEL = _table(id=_L, name=_S, version=_S)
LIBRARY = _table(
    slug=_S, name=_S, absolute_path=_S, is_active=_B, scan_status=_S, target_tagger_id=_L,
    sampling_limit=_L, deleted_at=_TS,
)
ASSET = _table(
    id=_L, library_id=_S, rel_path=_S, type=_S, mtime=_D, size=_L, status=_S, tags_model_id=_L,
    analysis_model_id=_L, worker_id=_S, lease_expires_at=_TS, retry_count=_L, error_message=_S,
    visual_analysis=VISUAL_ANALYSIS, preview_path=_S, video_preview_path=_S,
    segmentation_version=_L, raw_exif=T.MapType(_S, _S), media_metadata=MEDIA_METADATA,
    metadata_status=_S,
)
PROJECT = _table(id=_L, name=_S, created_at=_TS, export_path=_S)
PROJECT_ASSETS = _table(project_id=_L, asset_id=_L)
VIDEOFRAME = _table(id=_L, asset_id=_L, timestamp_ms=_L, is_keyframe=_B)
VIDEO_SCENES = _table(
    id=_L, asset_id=_L, start_ts=_D, end_ts=_D, description=_S, metadata=SCENE_METADATA,
    sharpness_score=_D, rep_frame_path=_S, keep_reason=_S,
)
VIDEO_ACTIVE_STATE = _table(
    asset_id=_L, anchor_phash=_S, scene_start_ts=_D, current_best_pts=_D,
    current_best_sharpness=_D,
)
WORKER_STATUS = _table(
    worker_id=_S, hostname=_S, last_seen_at=_TS, state=_S, command=_S, stats=T.MapType(_S, _S)
)
SYSTEM_METADATA = _table(key=_S, value=_S)
LIBRARY_MODEL_POLICY = _table(
    library_slug=_S, active_index_name=_S, shadow_index_name=_S, previous_index_name=_S,
    locked=_B, locked_since=_TS, promotion_progress=_D,
)
FILE_INVENTORY = _table(path=_S, mtime=_D, size=_L)
SOURCE_INVENTORY = _table(library_id=_S, rel_path=_S, type=_S, mtime=_D, size=_L)

# States and value sets stored as strings.
SCAN_STATUSES = ("idle", "full_scan_requested", "fast_scan_requested", "scanning")
ASSET_TYPES = ("image", "video")
ASSET_STATUSES = (
    "pending", "processing", "proxied", "extracting", "analyzing", "analyzed_light",
    "completed", "failed", "poisoned",
)
METADATA_STATUSES = ("exif_processing", "exif_done", "sharpness_processing", "complete")
WORKER_STATES = ("idle", "processing", "paused", "offline")
KEEP_REASONS = ("phash", "temporal", "forced")
HAS_DERIVATIVES = ("proxied", "analyzed_light", "completed", "extracting", "analyzing")
FINISHED = ("completed", "failed", "poisoned")
NO_THUMBNAIL = ("pending", "processing", "failed", "poisoned")
REANALYSABLE = ("completed", "analyzed_light", "analyzing")

# Supported file suffixes.
VIDEO_SUFFIXES = ("mkv", "mov", "mp4")
IMAGE_SUFFIXES = (
    "arw", "bmp", "cr2", "cr3", "crw", "dng", "jpeg", "jpg", "nef", "nrw", "orf", "png", "raf",
    "raw", "rw2", "rwl", "sr2", "srf", "tif", "tiff", "webp",
)
MEDIA_SUFFIXES = IMAGE_SUFFIXES + VIDEO_SUFFIXES

# Limits and thresholds.
MAX_RETRIES = 5
ACTIVE_WORKER_SECONDS = 60
TRANSCODE_SECONDS = 120
STALE_WORKER_HOURS = 24
PHASH_THRESHOLD = 51
SCENE_CEILING_SECONDS = 30.0
SCENE_DEBOUNCE_SECONDS = 3.0
SKIPPED_LEADING_FRAMES = 2
SEGMENTATION_VERSION = PHASH_THRESHOLD * 10000 + int(SCENE_DEBOUNCE_SECONDS * 1000)
SEMANTIC_DUPLICATE_RATIO = 85.0
SHARPNESS_FULL_SCALE = 1000.0
PATH_SHARDS = 1000


def invalid_rows(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose `column` holds a value outside its set (null passes)."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to a table schema; absent columns become null."""
    present = set(df.columns)

    def one(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])
