"""Normalisation of raw camera metadata held as a string map."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA_VERSION = 1
ORIGINAL_BITS_PER_PIXEL = 0.08
PROXY_BITS_PER_PIXEL = 0.03

# Metadata keys in order of preference, and the tokens that decide.
CAPTURE_KEYS = ("DateTimeOriginal", "MediaCreateDate", "CreateDate", "TrackCreateDate")
MODEL_KEYS = ("Model", "CameraModelName", "DeviceModelName")
FRAME_RATE_KEYS = ("VideoFrameRate", "AvgFrameRate", "FrameRate")
WIDTH_KEYS = ("ExifImageWidth", "ImageWidth", "SourceImageWidth")
HEIGHT_KEYS = ("ExifImageHeight", "ImageHeight", "SourceImageHeight")
PRIMARIES_KEYS = ("VideoColorPrimaries", "ColorPrimaries", "TransferFunction", "VideoTransferFunction")
LOG_KEY_WORDS = ("gamma", "profile", "curve", "picturestyle", "transfer")
LOG_TOKENS = ("s-log", "slog", "v-log", "vlog", "c-log", "clog", "logc", "f-log", "flog", " log")


def _contains_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def drop_vendor_keys(raw: Column, denied: Iterable[str] = ()) -> Column:
    """Without the tool's own file key, maker notes and the denied keys (any case)."""
    deny = [k.lower() for k in denied]

    def keep(key: Column, _: Column) -> Column:
        ok = (key != "SourceFile") & ~F.startswith(key, F.lit("MakerNote"))
        return ok & ~F.lower(key).isin(deny) if deny else ok

    return F.map_filter(raw, keep)


def exif_epoch(text: Column) -> Column:
    """Epoch seconds of `YYYY:MM:DD HH:MM:SS` read as UTC; null when it is anything else."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double")


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC. A missing plus sign reads as minus; a malformed offset is null."""
    clean = F.trim(text)
    pattern = r"^[+-]*(\d{1,9}):(\d{1,9})$"
    minutes = (
        F.regexp_extract(clean, pattern, 1).try_cast("bigint") * 60
        + F.regexp_extract(clean, pattern, 2).try_cast("bigint")
    )
    signed = F.when(F.startswith(clean, F.lit("+")), minutes).otherwise(-minutes)
    return F.when(minutes < 1440, signed)


def capture_time(raw: Column, mtime: Column) -> tuple[Column, Column]:
    """Capture time in epoch seconds and where it came from."""
    local = F.coalesce(*[exif_epoch(raw[k]) for k in CAPTURE_KEYS])
    offset = offset_minutes(raw["OffsetTimeOriginal"])
    when = F.coalesce(local - F.coalesce(offset, F.lit(0)) * 60, mtime.cast("double"))
    source = (
        F.when(local.isNotNull() & offset.isNotNull(), "exif")
        .when(local.isNotNull(), "exif_naive")
        .when(mtime.isNotNull(), "asset_mtime")
    )
    return when, source


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def camera(raw: Column) -> tuple[Column, Column]:
    return text_or_null(raw["Make"]), F.coalesce(*[text_or_null(raw[k]) for k in MODEL_KEYS])


def color_space(raw: Column) -> Column:
    wide = F.exists(
        F.map_entries(raw),
        lambda e: F.contains(F.lower(e["key"]), F.lit("profile"))
        & F.contains(F.lower(e["value"]), F.lit("p3")),
    )
    number = raw["ColorSpace"].try_cast("int")
    named = [
        F.when(_contains_any(F.upper(raw[k]), ("BT.709", "BT709")), "Rec709").when(
            _contains_any(F.upper(raw[k]), ("BT.2020", "BT2020")), "Rec2020"
        )
        for k in PRIMARIES_KEYS
    ]
    return (
        F.when(wide, "DisplayP3")
        .when(number == 1, "sRGB")
        .when(number == 2, "AdobeRGB")
        .otherwise(F.coalesce(*named, F.lit("Unknown")))
    )


def _rate(value: Column) -> Column:
    parts = F.split(value, "/", 2)
    over = F.get(parts, F.lit(0)).try_cast("double")
    under = F.get(parts, F.lit(1)).try_cast("double")
    ratio = F.when(under > 0, over / under)
    return F.when(F.contains(value, F.lit("/")), ratio).otherwise(value.try_cast("double"))


def frame_rate(raw: Column) -> Column:
    return F.coalesce(*[_rate(raw[k]) for k in FRAME_RATE_KEYS])


def duration(raw: Column) -> Column:
    """Seconds of a number, `h:m:s` or `m:s`."""
    text = raw["Duration"]
    fields = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    a, b, c = (F.get(fields, F.lit(i)) for i in range(3))
    return (
        F.when(F.size(fields) == 3, a * 3600 + b * 60 + c)
        .when(F.size(fields) == 2, a * 60 + b)
        .when(F.size(fields) == 1, a)
    )


def resolution(raw: Column) -> tuple[Column, Column]:
    def first(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[raw[k].try_cast("double").cast("bigint") for k in keys])

    return first(WIDTH_KEYS), first(HEIGHT_KEYS)


def generation_hint(raw: Column, is_video: Column, rate: Column, width: Column, height: Column) -> Column:
    """Whether footage looks like a camera original or a proxy."""
    log_curve = F.exists(
        F.map_entries(raw),
        lambda e: _contains_any(F.lower(e["key"]), LOG_KEY_WORDS)
        & _contains_any(F.lower(e["value"]), LOG_TOKENS),
    )
    usable = (rate > 0) & (width > 0) & (height > 0)
    bits = F.when(usable, F.nullif(raw["VideoBitrate"].try_cast("double"), F.lit(0.0)) / (width * height * rate))
    return (
        F.when(~is_video | log_curve, "original")
        .when(bits >= ORIGINAL_BITS_PER_PIXEL, "original")
        .when(bits <= PROXY_BITS_PER_PIXEL, "proxy")
        .otherwise("unknown")
    )


def gps(raw: Column) -> tuple[Column, Column]:
    """Latitude and longitude, both or neither."""
    lat, lon = raw["GPSLatitude"].try_cast("double"), raw["GPSLongitude"].try_cast("double")
    valid = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(valid, lat), F.when(valid, lon)


def media_metadata(raw: Column, kind: Column, mtime: Column, place: Column | None = None) -> Column:
    """The normalised struct; `place` holds country, region and city of the nearest known place."""
    is_video = kind == "video"
    taken, source = capture_time(raw, mtime)
    make, model = camera(raw)
    rate = F.when(is_video, frame_rate(raw))
    width, height = resolution(raw)
    lat, lon = gps(raw)

    def of_place(name: str) -> Column:
        return (place[name] if place is not None else F.lit(None).cast("string")).alias(name)

    return F.struct(
        F.lit(METADATA_VERSION).alias("metadata_version"),
        taken.alias("capture_ts"),
        source.alias("capture_ts_source"),
        make.alias("camera_make"),
        model.alias("camera_model"),
        color_space(raw).alias("color_space"),
        generation_hint(raw, is_video, rate, width, height).alias("generation_hint"),
        lat.alias("gps_lat"),
        lon.alias("gps_lon"),
        of_place("country"),
        of_place("region"),
        of_place("city"),
        width.alias("resolution_w"),
        height.alias("resolution_h"),
        F.when(is_video, duration(raw)).alias("duration_sec"),
        rate.alias("frame_rate"),
    )
