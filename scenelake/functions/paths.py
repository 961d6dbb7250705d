"""Column expressions over file paths, names, durations and sizes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.schemas import NO_THUMBNAIL, PATH_SHARDS, VIDEO_SUFFIXES


def suffix(path: Column) -> Column:
    """Lower-case text after the last dot; empty when there is no dot.

    Stored as an `ext` column by the inventory source, where an IN-filter on it reaches Parquet.
    """
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def has_suffix(path: Column, suffixes: Iterable[str]) -> Column:
    """Path ends in one of the suffixes, ignoring case; hash lookup instead of a regular expression."""
    return suffix(path).isin([s.lower().lstrip(".") for s in suffixes])


def has_media_suffix(asset: DataFrame, suffixes: Iterable[str]) -> Column:
    """The same for asset rows: the stored `ext` column, whose filter reaches Parquet, when there is one."""
    if "ext" in asset.columns:
        return F.col("ext").isin([s.lower().lstrip(".") for s in suffixes])
    return has_suffix(F.col("rel_path"), suffixes)


def asset_type(path: Column) -> Column:
    return F.when(has_suffix(path, VIDEO_SUFFIXES), "video").otherwise("image")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_and_ext(name: Column) -> tuple[Column, Column]:
    """File stem and dotted extension; a leading or trailing dot starts no extension."""
    ext = F.regexp_extract(name, r"^.*[^.](\.[^.]+)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def slugify(name: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("library"))


def export_folder(name: Column, project_id: Column) -> Column:
    """One dash per character that is neither letter nor digit; never empty."""
    dashed = F.btrim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "-"), F.lit("-"))
    return F.coalesce(
        F.nullif(dashed, F.lit("")), F.concat(F.lit("project-"), project_id.cast("string"))
    )


def normal_path(path: Column) -> Column:
    """Absolute path with `.`, `..` and empty segments resolved."""

    def step(kept: Column, part: Column) -> Column:
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(part.isin("", "."), kept)
            .when(part == "..", parent)
            .otherwise(F.concat(kept, F.array(part)))
        )

    start = F.array().cast("array<string>")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), start, step), "/"))


def join_path(root: Column, rel: Column) -> Column:
    """`rel` under `root`, unless it is itself absolute."""
    return F.when(F.startswith(rel, F.lit("/")), rel).otherwise(
        F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), rel)
    )


def escapes_root(root: Column, rel: Column) -> Column:
    top, full = normal_path(root), normal_path(join_path(root, rel))
    return ~((full == top) | F.startswith(full, F.concat(F.rtrim(top, F.lit("/")), F.lit("/"))))


def _sharded(library: Column, folder: str, asset_id: Column) -> Column:
    return F.concat(
        library, F.lit(f"/{folder}/"), F.pmod(asset_id, F.lit(PATH_SHARDS)).cast("string"),
        F.lit("/"), asset_id.cast("string"), F.lit(".jpg"),
    )


def thumbnail_path(library: Column, asset_id: Column) -> Column:
    return _sharded(library, "thumbnails", asset_id)


def proxy_path(library: Column, asset_id: Column) -> Column:
    return _sharded(library, "proxies", asset_id)


def head_clip_path(library: Column, asset_id: Column) -> Column:
    return F.concat(
        F.lit("video_clips/"), library, F.lit("/"), asset_id.cast("string"), F.lit("/head_clip.mp4")
    )


def scene_frame_path(library: Column, asset_id: Column, start: Column, end: Column) -> Column:
    """Where the representative frame of a scene is stored."""
    return F.format_string("video_scenes/%s/%d/%.3f_%.3f.jpg", library, asset_id, start, end)


def media_url(path: Column) -> Column:
    return F.concat(F.lit("/media/"), F.ltrim(path, F.lit("/")))


def thumbnail_url(library: Column, asset_id: Column, status: Column) -> Column:
    return F.when(~status.isin(*NO_THUMBNAIL), media_url(thumbnail_path(library, asset_id)))


def preview_url(kind: Column, frame_path: Column) -> Column:
    return F.when((kind == "video") & (F.length(frame_path) > 0), media_url(frame_path))


def mm_ss(seconds: Column, pad_minutes: bool = True) -> Column:
    """`mm:ss` of whole seconds; negative counts as zero."""
    whole = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    pattern = "%02d:%02d" if pad_minutes else "%d:%02d"
    text = F.format_string(pattern, F.floor(whole / 60), whole % 60)
    return F.when(seconds.isNotNull(), text)


def byte_size(n: Column) -> Column:
    kb = 1024

    def scaled(unit: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", F.bround(n / unit, 1))

    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < kb**2, scaled(kb, "KB"))
        .when(n < kb**3, scaled(kb**2, "MB"))
        .otherwise(scaled(kb**3, "GB"))
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of `30s`, `5m` or `1h`; null when malformed."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^(\d+)[smh]$", 1).try_cast("double")
    unit = F.when(F.endswith(clean, F.lit("h")), 3600.0).when(F.endswith(clean, F.lit("m")), 60.0)
    return number * unit.otherwise(1.0)


def parse_duration(text: str) -> float:
    """Driver-side form for job arguments; raises on malformed input."""
    match = re.fullmatch(r"(\d+)([smh])", (text or "").strip().lower())
    if match is None:
        raise ValueError("a duration is a whole number followed by s, m or h, such as 30s, 5m or 1h")
    return float(int(match[1]) * {"s": 1, "m": 60, "h": 3600}[match[2]])
