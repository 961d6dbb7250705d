"""Files on disk against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators import maintenance as mt
from scenelake.plans import oracle_parts as o
from scenelake.plans.registry import query
from scenelake.plans.tables import AS_OF, Catalog
from scenelake.sources.records import as_json

_THUMB = "library_id||'/thumbnails/'||(id%1000)||'/'||id||'.jpg'"
_PROXY = "library_id||'/proxies/'||(id%1000)||'/'||id||'.jpg'"
_EXPECTED = f"""select {_THUMB} as path from asset where {o.READY} and {o.IS_MEDIA} and {o.LIVE}
union select {_PROXY} from asset where {o.READY} and {o.IS_MEDIA} and {o.LIVE}
union select video_preview_path from asset where video_preview_path<>'' and {o.LIVE}
union select rep_frame_path from scene where rep_frame_path<>'' and asset_id in (select id from asset where {o.LIVE})"""


@query("expected_paths", _EXPECTED)
def expected_paths(c: Catalog) -> DataFrame:
    return mt.expected_paths(c.asset, c.scene, c.library)


_ORPHANS = f"""select path, mtime, size from (select *, case when split_part(path,'/',1) in ('video_clips','video_scenes') then split_part(path,'/',2)
  when split_part(path,'/',2) in ('thumbnails','proxies') then split_part(path,'/',1) end as slug from data_file) f
where mtime<{AS_OF}-900 and slug in (select slug from library where deleted_epoch is null) and path not in (select path from expected)"""


@query("orphan_files", _ORPHANS, {"expected": _EXPECTED})
def orphan_files(c: Catalog) -> DataFrame:
    return mt.orphan_files(c.data_file, c.asset, c.scene, c.library, 900, AS_OF)


@query("orphan_totals", f"select count(*) as file_count, coalesce(sum(size),0)::bigint as total_bytes from ({_ORPHANS}) q", {"expected": _EXPECTED})
def orphan_totals(c: Catalog) -> DataFrame:
    return mt.file_totals(mt.orphan_files(c.data_file, c.asset, c.scene, c.library, 900, AS_OF))


@query("temp_preview", f"""select 'all' as scope, count(*) as file_count, coalesce(sum(size),0)::bigint as total_bytes from data_file where path like 'tmp/%' and mtime<{AS_OF}-1800
union all select 'src5', count(*), coalesce(sum(size),0)::bigint from data_file where path like 'tmp/src5/%' and mtime<{AS_OF}-1800""")
def temp_preview(c: Catalog) -> DataFrame:
    """What a clean-up of temporary files would remove, everywhere and in one library."""
    def scope(name: str, slug: str | None) -> DataFrame:
        totals = mt.file_totals(mt.temp_files(c.data_file, 1800, AS_OF, slug))
        return totals.select(F.lit(name).alias("scope"), "file_count", "total_bytes")

    return scope("all", None).unionByName(scope("src5", "src5"))


@query("missing_sources", f"""select id, library_id, rel_path, id in (select asset_id from project_assets) as protected from asset a
where {o.LIVE} and not exists (select 1 from source_file f where f.library_id=a.library_id and f.rel_path=a.rel_path)""")
def missing_sources(c: Catalog) -> DataFrame:
    return mt.missing_sources(c.asset, c.library, c.project_assets, c.source_file)


@query("reap_missing", f"""select 'asset' as table_name, id as key from asset a where id not in (select id from doomed)
union all select 'scene', id from scene where asset_id not in (select id from doomed)""",
       {"doomed": f"""select id from asset a where {o.LIVE} and id not in (select asset_id from project_assets)
  and not exists (select 1 from source_file f where f.library_id=a.library_id and f.rel_path=a.rel_path)"""})
def reap_missing(c: Catalog) -> DataFrame:
    """Keys left after assets without a source are deleted; project members stay."""
    from scenelake.operators.lifecycle import delete_assets

    ids = mt.missing_sources(c.asset, c.library, c.project_assets, c.source_file).select("id")
    left, _ = delete_assets(ids, c.project_assets, {"asset": c.asset, "scene": c.scene})
    assets = left["asset"].select(F.lit("asset").alias("table_name"), F.col("id").alias("key"))
    return assets.unionByName(left["scene"].select(F.lit("scene").alias("table_name"), F.col("id").alias("key")))


@query("missing_derivatives", f"""select id, library_id, type, no_thumbnail, no_preview from (
  select id, library_id, type, {_THUMB} not in (select path from filled) as no_thumbnail,
    case when type='image' then {_PROXY} else 'video_clips/'||library_id||'/'||id||'/head_clip.mp4' end not in (select path from filled) as no_preview
  from asset where {o.READY} and {o.IS_MEDIA} and {o.LIVE}) q where no_thumbnail or no_preview""",
       {"filled": "select path from data_file where size>0"})
def missing_derivatives(c: Catalog) -> DataFrame:
    return mt.missing_derivatives(c.asset, c.library, c.data_file)


_DURATIONS = "select asset_id, cast(max(pts)*0.9+asset_id%30 as double) as duration_sec from frame group by asset_id"


@query("truncated_indexes", """select d.asset_id, round(duration_sec,6) as duration_sec, indexed_to from durations d join (select asset_id, max(end_ts) as indexed_to from scene group by 1) s
on s.asset_id=d.asset_id where indexed_to<duration_sec-least(2.0,duration_sec*0.02)""", {"durations": _DURATIONS})
def truncated_indexes(c: Catalog) -> DataFrame:
    """Videos whose scenes end before the video does."""
    durations = c.frame.groupBy("asset_id").agg(F.max("pts").alias("m")).select(
        "asset_id", (F.col("m") * 0.9 + F.col("asset_id") % 30).cast("double").alias("duration_sec")
    )
    rows = mt.truncated_indexes(c.scene, durations)
    return rows.select("asset_id", F.round("duration_sec", 6).alias("duration_sec"), "indexed_to")


@query("scene_json_dump", """select id, to_json({'id': id, 'asset_id': asset_id, 'start_ts': start_ts, 'end_ts': end_ts, 'description': description,
  'sharpness_score': sharpness_score, 'rep_frame_path': rep_frame_path, 'keep_reason': keep_reason,
  'metadata': case when has_analysis then {'analysis': {'description': description, 'tags': [tag], 'ocr_text': ocr_text, 'ocr_done': ocr_done},
    'showinfo': null::varchar, 'semantic_duplicate': null::boolean} end})::varchar as json from scene""")
def scene_json_dump(c: Catalog) -> DataFrame:
    """Every field of every scene."""
    return as_json(c.scene.select(
        "id", "asset_id", "start_ts", "end_ts", "description", "sharpness_score", "rep_frame_path", "keep_reason", "metadata"
    ))
