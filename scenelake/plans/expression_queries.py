"""Queries made of column expressions: paths, text, camera metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import exif, frames, paths, text
from scenelake.operators.geo import reverse_geocode
from scenelake.plans import oracle_parts as o
from scenelake.plans.registry import query
from scenelake.plans.tables import Catalog, normalised_metadata


@query("asset_type_from_path", f"select id, {o.EXT} as ext, case when {o.IS_VIDEO} then 'video' else 'image' end as type from asset")
def asset_type_from_path(c: Catalog) -> DataFrame:
    path = F.col("rel_path")
    return c.asset.select("id", paths.suffix(path).alias("ext"), paths.asset_type(path).alias("type"))


@query(
    "exif_filter_keys",
    """select id, concat_ws('|', case when avg_frame_rate is not null then 'AvgFrameRate' end,
  case when camera_model_name is not null then 'CameraModelName' end, case when color_primaries is not null then 'ColorPrimaries' end,
  case when color_space is not null then 'ColorSpace' end, case when create_date is not null then 'CreateDate' end,
  case when date_time_original is not null then 'DateTimeOriginal' end, case when device_model_name is not null then 'DeviceModelName' end,
  case when duration is not null then 'Duration' end, case when exif_image_width is not null then 'ExifImageWidth' end,
  case when gps_latitude is not null then 'GPSLatitude' end, case when gps_longitude is not null then 'GPSLongitude' end,
  case when gamma_curve is not null then 'GammaCurve' end, case when icc_profile_name is not null then 'ICCProfileName' end,
  case when image_height is not null then 'ImageHeight' end, case when image_width is not null then 'ImageWidth' end,
  case when make is not null then 'Make' end, case when model is not null then 'Model' end,
  case when offset_time_original is not null then 'OffsetTimeOriginal' end, case when video_bitrate is not null then 'VideoBitrate' end,
  case when video_frame_rate is not null then 'VideoFrameRate' end) as kept_keys from exif""",
)
def exif_filter_keys(c: Catalog) -> DataFrame:
    """Keys left after dropping the file key, maker notes and a denied key in another case."""
    kept = exif.drop_vendor_keys(F.col("raw_exif"), ["serialnumber"])
    return c.exif.select("id", F.array_join(F.array_sort(F.map_keys(kept)), "|").alias("kept_keys"))


@query("slugify", r"""select id, coalesce(nullif(trim(regexp_replace(lower(rel_path),'[^a-z0-9]+','-','g'),'-'),''),'library') as slug from asset""")
def slugify(c: Catalog) -> DataFrame:
    return c.asset.select("id", paths.slugify(F.col("rel_path")).alias("slug"))


@query("safe_name", r"""select id, coalesce(nullif(trim(regexp_replace(lower(rel_path),'[^\p{L}\p{N}]','-','g'),'-'),''),'project-'||id) as folder from asset
union all select id, coalesce(nullif(trim(regexp_replace(lower(name),'[^\p{L}\p{N}]','-','g'),'-'),''),'project-'||id) from project""")
def safe_name(c: Catalog) -> DataFrame:
    """Folder names made from asset paths and project names."""
    named = c.asset.select("id", F.col("rel_path").alias("name")).unionByName(c.project.select("id", "name"))
    return named.select("id", paths.export_folder(F.col("name"), F.col("id")).alias("folder"))


@query("path_escapes_root", """select id, case id%5 when 0 then '../'||rel_path when 1 then 'a/../'||rel_path when 2 then '/mnt/'||library_id||'/x'
  when 3 then './a/../../'||library_id||'/'||rel_path else rel_path end as rel, id%5=0 as escapes from asset""")
def path_escapes_root(c: Catalog) -> DataFrame:
    rel, lib = F.col("rel_path"), F.col("library_id")
    kind = F.col("id") % 5
    tricky = (
        F.when(kind == 0, F.concat(F.lit("../"), rel)).when(kind == 1, F.concat(F.lit("a/../"), rel))
        .when(kind == 2, F.concat(F.lit("/mnt/"), lib, F.lit("/x")))
        .when(kind == 3, F.concat(F.lit("./a/../../"), lib, F.lit("/"), rel)).otherwise(rel)
    )
    root = F.concat(F.lit("/mnt/"), lib)
    return c.asset.select("id", tricky.alias("rel"), paths.escapes_root(root, tricky).alias("escapes"))


@query("format_bytes", """select id, case when n<1024 then n||' B' when n<1048576 then printf('%.1f KB', n/1024.0)
  when n<1073741824 then printf('%.1f MB', n/1048576.0) else printf('%.1f GB', n/1073741824.0) end as pretty,
  case id%4 when 0 then 1.0*(id%90) when 1 then 60.0*(id%90) when 2 then 3600.0*(id%90) end::double as seconds
from (select id, size*(case id%4 when 0 then 1 when 1 then 1000 when 2 then 1000000 else 10000000 end) as n from asset) q""")
def format_bytes(c: Catalog) -> DataFrame:
    """Byte sizes and duration texts of every asset."""
    kind = F.col("id") % 4
    size = F.col("size") * F.when(kind == 0, 1).when(kind == 1, 1000).when(kind == 2, 1000000).otherwise(10000000)
    unit = F.when(kind == 0, "s").when(kind == 1, " M ").when(kind == 2, "h").otherwise("d")
    span = F.concat((F.col("id") % 90).cast("string"), F.trim(unit))
    return c.asset.select(
        "id", paths.byte_size(size).alias("pretty"), paths.duration_seconds(span).alias("seconds")
    )


@query("tokenize", f"""select id, len(ws)::bigint as n_words, len(kept)::bigint as n_kept, len(list_distinct(kept))::bigint as n_distinct,
  coalesce(list_sum(list_transform(kept, lambda x: length(x))),0)::bigint as kept_length
from (select id, ws, list_filter(ws, lambda x: x not in {o._in(text.STOP_WORDS)}) as kept
      from (select id, {o.split('description')} as ws from image_asset) a) b""")
def tokenize(c: Catalog) -> DataFrame:
    """Words of every description, with and without stop words."""
    words = c.asset.where(F.col("type") == "image").select(
        "id", text.tokens(F.col("visual_analysis.description")).alias("ws")
    ).withColumn("kept", text.without_stop_words(F.col("ws")))
    total = F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
    return words.select(
        "id", F.size("ws").cast("bigint").alias("n_words"), F.size("kept").cast("bigint").alias("n_kept"),
        F.size(F.array_distinct("kept")).cast("bigint").alias("n_distinct"), total.alias("kept_length"),
    )


@query("parse_tags", """select id, array_to_string(list_distinct_first, '|') as tags from (
  select id, list_filter(parts, lambda x, i: x<>'' and list_position(parts, x)=i) as list_distinct_first from (
    select id, list_transform(string_split(replace(replace(coalesce(txt,''),chr(10),' '),chr(13),' '), ','), lambda x: trim(x)) as parts
    from (select id, description as txt from scene) a) b) c""")
def parse_tags(c: Catalog) -> DataFrame:
    """Descriptions read as comma-separated tag lists."""
    flat = F.translate(F.coalesce("description", F.lit("")), "\n\r", "  ")
    return c.scene.select("id", F.array_join(text.parse_tags(flat), "|").alias("tags"))


@query("clean_ocr", """select id, case when id%3=0 then null when id%3=1 and length(ocr_text)>0 then trim(ocr_text) end as ocr
from (select id, case id%3 when 0 then ' NONE ' when 1 then '  '||description||' ' end as ocr_text from scene) q""")
def clean_ocr(c: Catalog) -> DataFrame:
    kind = F.col("id") % 3
    reply = F.when(kind == 0, " NONE ").when(kind == 1, F.concat(F.lit("  "), "description", F.lit(" ")))
    return c.scene.select("id", text.clean_ocr(reply).alias("ocr"))


@query("similarity_terms", rf"""select id, case when tags is null then clean else array_to_string(list_concat(words, tags, tags), ' ') end as query_text
from (select id, clean, list_filter(ws, lambda x, i: x<>'' and list_position(ws, x)=i) as words, tags from (
  select id, clean, string_split(clean,' ') as ws, tags from (
    select id, trim(regexp_replace(regexp_replace(coalesce(description,''), '[-"()\[\]{{}}:^~*?\\/+!&|]', ' ', 'g'), '\s+', ' ', 'g')) as clean,
      case when tag1 is not null then list_distinct_sorted end as tags
    from (select id, description, tag1, case when lower(tag1)=lower(tag2) then [lower(tag1)] else [lower(tag1), lower(tag2)] end as list_distinct_sorted from asset) a) b) c) d""")
def similarity_terms(c: Catalog) -> DataFrame:
    va = F.col("visual_analysis")
    return c.asset.select("id", text.similarity_query(va["description"], va["tags"]).alias("query_text"))


@query("norm_sharpness", "select frame_id, round(greatest(0, least(1, sharpness*20/1000)),6)::double as sharpness_score from frame")
def norm_sharpness(c: Catalog) -> DataFrame:
    score = frames.normalised_sharpness(F.col("sharpness") * 20)
    return c.frame.select("frame_id", F.round(score, 6).alias("sharpness_score"))


def _lanes() -> str:
    return "+".join(
        f"bit_count(xor(('0x'||substr(a.phash,{i},8))::bigint, ('0x'||substr(f.phash,{i},8))::bigint))::bigint"
        for i in range(1, 65, 8)
    )


@query("phash_distance", f"""select f.frame_id, ({_lanes()})::bigint as distance
from frame f join (select asset_id, min_by(phash, frame_id) as phash from frame group by asset_id) a using (asset_id)""")
def phash_distance(c: Catalog) -> DataFrame:
    """Distance of every frame from the first frame of its video."""
    first = c.frame.groupBy("asset_id").agg(F.min_by("phash", "frame_id").alias("anchor"))
    distance = frames.phash_distance(F.col("anchor"), F.col("phash"))
    return c.frame.join(first, "asset_id").select("frame_id", distance.cast("bigint").alias("distance"))


@query("capture_ts", f"select id, {o.CAPTURE_TS} as capture_ts, {o.CAPTURE_SOURCE} as source from exif")
def capture_ts(c: Catalog) -> DataFrame:
    when, source = exif.capture_time(F.col("raw_exif"), F.col("mtime"))
    return c.exif.select("id", when.alias("capture_ts"), source.alias("source"))


@query("camera_fields", f"select id, {o.MAKE} as camera_make, {o.MODEL} as camera_model from exif")
def camera_fields(c: Catalog) -> DataFrame:
    make, model = exif.camera(F.col("raw_exif"))
    return c.exif.select("id", make.alias("camera_make"), model.alias("camera_model"))


@query("color_space", f"select id, {o.COLOR} as color_space from exif")
def color_space(c: Catalog) -> DataFrame:
    return c.exif.select("id", exif.color_space(F.col("raw_exif")).alias("color_space"))


@query("frame_rate", f"select id, round({o.RATE},6) as frame_rate from exif")
def frame_rate(c: Catalog) -> DataFrame:
    rate = F.when(F.col("type") == "video", exif.frame_rate(F.col("raw_exif")))
    return c.exif.select("id", F.round(rate, 6).alias("frame_rate"))


@query("duration_sec", f"select id, {o.DURATION} as duration_sec from exif")
def duration_sec(c: Catalog) -> DataFrame:
    value = F.when(F.col("type") == "video", exif.duration(F.col("raw_exif")))
    return c.exif.select("id", value.alias("duration_sec"))


@query("resolution", f"select id, {o.WIDTH} as width, {o.HEIGHT} as height from exif")
def resolution(c: Catalog) -> DataFrame:
    width, height = exif.resolution(F.col("raw_exif"))
    return c.exif.select("id", width.alias("width"), height.alias("height"))


@query("generation_hint", f"select id, {o.HINT} as generation_hint from exif")
def generation_hint(c: Catalog) -> DataFrame:
    raw, video = F.col("raw_exif"), F.col("type") == "video"
    width, height = exif.resolution(raw)
    hint = exif.generation_hint(raw, video, F.when(video, exif.frame_rate(raw)), width, height)
    return c.exif.select("id", hint.alias("generation_hint"))


@query(
    "reverse_geocode",
    "select p.id, country, region, city, round(angle,6) as angle from pts p left join nearest n on n.id=p.id",
    o.GEO_CTES,
)
def geocode(c: Catalog) -> DataFrame:
    """Nearest place of every asset; null without a valid position."""
    lat, lon = exif.gps(F.col("raw_exif"))
    found = reverse_geocode(c.exif.select("id", lat.alias("lat"), lon.alias("lon")), c.gazetteer)
    return found.select("id", "place.country", "place.region", "place.city", F.round("angle", 6).alias("angle"))


@query(
    "media_metadata",
    f"""select e.id, 1 as metadata_version, {o.CAPTURE_TS} as capture_ts, {o.CAPTURE_SOURCE} as capture_ts_source,
  {o.MAKE} as camera_make, {o.MODEL} as camera_model, {o.COLOR} as color_space, {o.HINT} as generation_hint,
  {o.LAT} as gps_lat, {o.LON} as gps_lon, country, region, city, {o.WIDTH} as resolution_w, {o.HEIGHT} as resolution_h,
  {o.DURATION} as duration_sec, round({o.RATE},6) as frame_rate
from exif e left join nearest n on n.id=e.id""",
    o.GEO_CTES,
)
def media_metadata(c: Catalog) -> DataFrame:
    """All normalised fields of every asset."""
    return normalised_metadata(c.exif, c.gazetteer).select("id", "m.*").withColumn("frame_rate", F.round("frame_rate", 6))
