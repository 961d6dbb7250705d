"""Snapshots after updates, deletes and policy transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import exif
from scenelake.operators import changes as ch
from scenelake.operators import lifecycle as life
from scenelake.operators import maintenance as mt
from scenelake.operators.catalog import live_assets
from scenelake.operators.geo import reverse_geocode
from scenelake.plans import oracle_parts as o
from scenelake.plans.registry import query
from scenelake.plans.tables import AS_OF, Catalog

_STATE = "id, status, worker_id, lease_epoch, retry_count, error_message"


def _state(asset: DataFrame) -> DataFrame:
    return asset.select(
        "id", "status", "worker_id", F.unix_seconds("lease_expires_at").alias("lease_epoch"),
        "retry_count", "error_message",
    )


@query(
    "scan_upsert",
    """select id, library_id, rel_path, type, mtime, size, status, tags_model_id, worker_id, lease_epoch, retry_count, preview_path, video_preview_path
from old union all
select (select max(id) from asset)+row_number() over (order by bucket, library_id, rel_path), library_id, rel_path, type, mtime, size, 'pending',
  null, null, null, 0, null, null from fresh""",
    {
        "old": """select a.id, a.library_id, a.rel_path, coalesce(f.type,a.type) as type, coalesce(f.mtime,a.mtime) as mtime, coalesce(f.size,a.size) as size,
  case when hit and differs then 'pending' else status end as status, case when hit and differs then null else tags_model_id end as tags_model_id,
  case when hit and differs then null else worker_id end as worker_id, case when hit and differs then null else lease_epoch end as lease_epoch,
  retry_count, case when hit and differs and a.type='video' then null else preview_path end as preview_path,
  case when hit and differs and a.type='video' then null else video_preview_path end as video_preview_path
from (select a.*, f.library_id is not null as hit, a.mtime is distinct from f.mtime or a.size is distinct from f.size as differs,
  f.type as ft, f.mtime as fm, f.size as fs from asset a left join source_file f on f.library_id=a.library_id and f.rel_path=a.rel_path) a
left join source_file f on f.library_id=a.library_id and f.rel_path=a.rel_path""",
        "fresh": """select *, ('0x'||substr(md5(library_id||'/'||rel_path),1,3))::int as bucket from source_file f
where not exists (select 1 from asset a where a.library_id=f.library_id and a.rel_path=f.rel_path)""",
    },
)
def scan_upsert(c: Catalog) -> DataFrame:
    rows = ch.scan_upsert(c.asset, c.source_file)
    return rows.select(
        "id", "library_id", "rel_path", "type", "mtime", "size", "status", "tags_model_id", "worker_id",
        F.unix_seconds("lease_expires_at").alias("lease_epoch"), "retry_count", "preview_path",
        "video_preview_path",
    )


@query("scan_diff", """select f.library_id, f.rel_path, a.id, case when a.id is null then 'new' when a.mtime is distinct from f.mtime or a.size is distinct from f.size
then 'changed' else 'unchanged' end as change from source_file f left join asset a on a.library_id=f.library_id and a.rel_path=f.rel_path""")
def scan_diff(c: Catalog) -> DataFrame:
    return ch.scan_diff(c.asset, c.source_file).select("library_id", "rel_path", "id", "change")


@query("scan_invalidated", """select id, asset_id, start_ts from scene where asset_id not in (select a.id from asset a join source_file f
on f.library_id=a.library_id and f.rel_path=a.rel_path where a.type='video' and (a.mtime is distinct from f.mtime or a.size is distinct from f.size))""")
def scan_invalidated(c: Catalog) -> DataFrame:
    """Scenes that survive a scan."""
    gone = ch.changed_videos(c.asset, c.source_file)
    return life.without_assets(gone, {"scene": c.scene})["scene"].select("id", "asset_id", "start_ts")


def _retry(prefix: str = "") -> str:
    return f"case when {prefix}new_status in ('failed','poisoned') then retry_count+1 when {prefix}new_status in ('proxied','analyzed_light','completed') then 0 else retry_count end"


@query(
    "apply_status",
    f"""select a.id, case when ok then new_status else status end as status, case when ok then null else worker_id end as worker_id,
  case when ok then null else lease_epoch end as lease_epoch, case when ok then {_retry()} else retry_count end as retry_count,
  case when ok then new_error else error_message end as error_message
from (select a.*, c.new_status, c.new_error, c.id is not null and a.worker_id=c.owner as ok from asset a left join upd c using (id)) a""",
    {"upd": """select id, case id%4 when 0 then 'failed' when 1 then 'proxied' when 2 then 'completed' else 'pending' end as new_status,
  case when id%4=0 then 'boom' end as new_error, 'w'||(cast(floor(id/2) as bigint)%150 - case when id%3=0 then 1 else 0 end) as owner from asset where status='processing'"""},
)
def apply_status(c: Catalog) -> DataFrame:
    """Results reported by workers; a third of them no longer own their asset."""
    kind = F.col("id") % 4
    number = F.floor(F.col("id") / 2) % 150 - F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    updates = c.asset.where(F.col("status") == "processing").select(
        "id", F.when(kind == 0, "failed").when(kind == 1, "proxied").when(kind == 2, "completed").otherwise("pending").alias("status"),
        F.when(kind == 0, "boom").alias("error_message"), F.concat(F.lit("w"), number.cast("string")).alias("owner"),
    )
    return _state(ch.apply_status(c.asset, updates, check_owner=True))


@query("finish_analysis", """select id, case when worker_id is not null and id%3<>0 then 'completed' else status end as status,
  case when worker_id is not null and id%3<>0 then 7 else analysis_model_id end as analysis_model_id,
  case when worker_id is not null and id%3<>0 then 0 else retry_count end as retry_count,
  case when worker_id is not null and id%3=0 then worker_id end as worker_id from asset""")
def finish_analysis(c: Catalog) -> DataFrame:
    owner = F.when(F.col("id") % 3 == 0, "somebody-else").otherwise(F.col("worker_id"))
    done = c.asset.where(F.col("worker_id").isNotNull()).select(
        "id", F.lit(7).cast("bigint").alias("model_id"), owner.alias("owner")
    )
    rows = ch.finish_analysis(c.asset, done, "completed")
    return rows.select("id", "status", "analysis_model_id", "retry_count", "worker_id")


_EXPIRED = f"status='processing' and lease_epoch is not null and lease_epoch<{AS_OF}"


@query("reclaim_leases", f"""select id, case when x and retry_count>5 then 'poisoned' when x then 'pending' else status end as status,
  case when not x then worker_id end as worker_id, case when not x then lease_epoch end as lease_epoch,
  case when x and retry_count>5 then retry_count+1 else retry_count end as retry_count,
  case when x and retry_count>5 then 'lease ran out too often' else error_message end as error_message
from (select *, coalesce({_EXPIRED}, false) as x from asset) q""")
def reclaim_leases(c: Catalog) -> DataFrame:
    return _state(ch.reclaim_leases(c.asset, AS_OF))


@query("reset_poisoned", """select id, case when status='poisoned' then 'pending' else status end as status, worker_id, lease_epoch,
  case when status='poisoned' then 0 else retry_count end as retry_count, case when status<>'poisoned' then error_message end as error_message from asset""")
def reset_poisoned(c: Catalog) -> DataFrame:
    return _state(ch.reset_poisoned(c.asset))


@query("reset_stuck_metadata", f"""select id, case when mtime<{AS_OF}-6000000.0 and metadata_status='sharpness_processing' then 'exif_done'
  when mtime<{AS_OF}-6000000.0 and metadata_status='exif_processing' then null else metadata_status end as metadata_status from asset""")
def reset_stuck_metadata(c: Catalog) -> DataFrame:
    return ch.reset_stuck_metadata(c.asset, 6_000_000, AS_OF).select("id", "metadata_status")


@query("write_exif", f"""select e.id, 1 as metadata_version, {o.CAPTURE_TS} as capture_ts, {o.CAPTURE_SOURCE} as capture_ts_source,
  {o.MAKE} as camera_make, {o.MODEL} as camera_model, {o.COLOR} as color_space, {o.HINT} as generation_hint, {o.LAT} as gps_lat, {o.LON} as gps_lon,
  country, region, city, {o.WIDTH} as resolution_w, {o.HEIGHT} as resolution_h, {o.DURATION} as duration_sec, round({o.RATE},6) as frame_rate,
  null::boolean as has_face, null::bigint as face_count, null::double as sharpness_score, 'exif_done' as metadata_status
from exif e left join nearest n on n.id=e.id""", o.GEO_CTES)
def write_exif(c: Catalog) -> DataFrame:
    """Raw metadata of all assets with their places, stored with every normalised field."""
    asset = c.asset.withColumn("raw_exif", F.lit(None).cast("map<string,string>")).withColumn(
        "media_metadata", F.lit(None).cast(ch.MEDIA_METADATA)
    )
    lat, lon = exif.gps(F.col("raw_exif"))
    placed = reverse_geocode(c.exif.select("id", "raw_exif", lat.alias("lat"), lon.alias("lon")), c.gazetteer)
    rows = ch.write_exif(asset, placed.select("id", "raw_exif", "place"))
    return rows.select("id", "media_metadata.*", "metadata_status").withColumn("frame_rate", F.round("frame_rate", 6))


@query(
    "merge_sharpness",
    f"""select e.id, {o.MAKE} as camera_make, case when hit then id%2=0 end as has_face, case when hit then id%4 end as face_count,
  case when hit then (id%100)/100.0::double end as sharpness_score, case when hit then 'complete' else metadata_status end as metadata_status
from (select e.*, a.metadata_status, coalesce(a.metadata_status='sharpness_processing',false) as hit from exif e join asset a using (id)) e""",
)
def merge_sharpness(c: Catalog) -> DataFrame:
    """Measurements for every asset; only those waiting for them take them, and keep other fields."""
    known = c.exif.select("id", F.struct(
        *[(F.nullif(F.trim(F.col("raw_exif")["Make"]), F.lit("")) if f.name == "camera_make" else F.lit(None))
          .cast(f.dataType).alias(f.name) for f in ch.MEDIA_METADATA.fields]
    ).alias("media_metadata"))
    asset = c.asset.select("id", "metadata_status").join(known, "id")
    found = c.asset.select(
        "id", (F.col("id") % 2 == 0).alias("has_face"), (F.col("id") % 4).alias("face_count"),
        ((F.col("id") % 100) / 100).alias("sharpness_score"),
    )
    return ch.merge_sharpness(asset, found).select(
        "id", "media_metadata.camera_make", "media_metadata.has_face", "media_metadata.face_count",
        "media_metadata.sharpness_score", "metadata_status",
    )


@query("save_analysis", """select id, case when id%5=0 then 'seen '||id else description end as description, case when id%5=0 then 'a|b' else coalesce(tag1||'|'||tag2,'') end as tags,
  case when id%5<>0 then ocr_text end as ocr_text, case when id%5=0 then 'mock-analyzer' end as model_name from asset""")
def save_analysis(c: Catalog) -> DataFrame:
    new = c.asset.where(F.col("id") % 5 == 0).select(
        "id", F.concat(F.lit("seen "), F.col("id").cast("string")).alias("description"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit(None).cast("string").alias("ocr_text"),
        F.lit("mock-analyzer").alias("model_name"), F.lit("1.0").alias("model_version"),
    )
    rows = ch.save_analysis(c.asset, new)
    va = F.col("visual_analysis")
    return rows.select(
        "id", va["description"].alias("description"),
        F.array_join(F.coalesce(va["tags"], F.array().cast("array<string>")), "|").alias("tags"),
        va["ocr_text"].alias("ocr_text"), va["model_name"].alias("model_name"),
    )


@query("merge_ocr", """select id, description, coalesce(tag1,'') as first_tag, case id%4 when 0 then 'text '||id when 1 then null else ocr_text end as ocr_text,
  has_analysis or id%4 in (0,1) as analysed from asset""")
def merge_ocr(c: Catalog) -> DataFrame:
    """Text set, or set to nothing, without touching description and tags."""
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("text "), F.col("id").cast("string")))
    new = c.asset.where((F.col("id") % 4).isin(0, 1)).select("id", text.alias("ocr_text"))
    rows = ch.merge_ocr(c.asset, new)
    va = F.col("visual_analysis")
    return rows.select(
        "id", va["description"].alias("description"), F.coalesce(va["tags"][0], F.lit("")).alias("first_tag"),
        va["ocr_text"].alias("ocr_text"), va.isNotNull().alias("analysed"),
    )


@query("apply_attributes", """select a.id, coalesce(case when a.type='video' and coalesce(video_preview_path,'')='' and f.path is not null then f.path end, video_preview_path) as video_preview_path
from asset a left join (select path from data_file where size>0) f on f.path='video_clips/'||a.library_id||'/'||a.id||'/head_clip.mp4'""")
def apply_attributes(c: Catalog) -> DataFrame:
    """Head clips found on disk recorded in the assets that lack the path."""
    updates = mt.missing_head_clip_paths(c.asset, c.data_file)
    return ch.apply_attributes(c.asset, updates).select("id", "video_preview_path")


@query("retry_policy", """select id, stage, kind, case when kind='transient' and stage in ('image_analysis','video_analysis') then 'proxied'
  when kind='permanent' or stage='image_analysis' then 'poisoned' when retry_count>5 then 'poisoned' else 'failed' end as status,
  case when kind='transient' and stage in ('image_analysis','video_analysis') then null
  when stage='video_proxy' and kind<>'permanent' and retry_count>5 then 'oops'||chr(10)||chr(10)||'gave up after too many tries ('||retry_count||' > 5)' else 'oops' end as message
from (select id, retry_count, case id%4 when 0 then 'image_analysis' when 1 then 'video_analysis' when 2 then 'video_proxy' else 'image_proxy' end as stage,
  case cast(floor(id/4) as bigint)%3 when 0 then 'transient' when 1 then 'permanent' else 'other' end as kind from asset) q""")
def retry_policy(c: Catalog) -> DataFrame:
    number = F.col("id") % 4
    stage = F.when(number == 0, "image_analysis").when(number == 1, "video_analysis").when(number == 2, "video_proxy").otherwise("image_proxy")
    third = F.floor(F.col("id") / 4) % 3
    kind = F.when(third == 0, ch.TRANSIENT).when(third == 1, ch.PERMANENT).otherwise(ch.OTHER)
    return c.asset.select(
        "id", stage.alias("stage"), kind.alias("kind"),
        ch.status_after_failure(stage, kind, F.lit("proxied"), F.col("retry_count")).alias("status"),
        ch.error_after_failure(stage, kind, F.lit("oops"), F.col("retry_count")).alias("message"),
    )


@query("library_trash", f"""select slug, case when slug in ('src1','src2') then {AS_OF} when slug='src6' then null else deleted_epoch end as deleted_epoch,
  (select count(*) from asset a where a.library_id=slug) as assets from library""")
def library_trash(c: Catalog) -> DataFrame:
    """Two libraries trashed and one restored, with the assets each still has."""
    rows = life.set_trash(life.set_trash(c.library, ["src1", "src2"], AS_OF), ["src6"], None)
    sizes = c.asset.groupBy(F.col("library_id").alias("slug")).agg(F.count("*").alias("n"))
    return rows.join(sizes, "slug", "left").select(
        "slug", F.unix_seconds("deleted_at").alias("deleted_epoch"), F.coalesce("n", F.lit(0)).alias("assets")
    )


_GONE = "library_id in (select slug from library where deleted_epoch is not null)"


@query("hard_delete", f"""select 'asset' as table_name, id as key from asset where not {_GONE}
union all select 'scene', id from scene where asset_id not in (select id from asset where {_GONE})
union all select 'project_assets', asset_id*10+project_id from project_assets where asset_id not in (select id from asset where {_GONE})
union all select 'library', cast(substr(slug,4) as bigint) from library where deleted_epoch is null
union all select 'policy', cast(substr(library_slug,4) as bigint) from policy where library_slug not in (select slug from library where deleted_epoch is not null)
union all select 'frame', frame_id from frame where asset_id not in (select id from asset where {_GONE})
union all select 'state', asset_id from frame where asset_id not in (select id from asset where {_GONE}) group by asset_id""")
def hard_delete(c: Catalog) -> DataFrame:
    """Keys left in every table after the trash is emptied."""
    # A state for each video that is being watched: its first frame, still open.
    states = c.frame.groupBy("asset_id").agg(F.min_by("phash", "pts").alias("anchor_phash"), F.min("pts").alias("scene_start_ts"))
    left = life.hard_delete(
        c.library, c.policy,
        {"asset": c.asset, "scene": c.scene, "project_assets": c.project_assets, "frame": c.frame, "state": states},
    )
    keys = {
        "frame": F.col("frame_id"), "state": F.col("asset_id"),
        "asset": F.col("id"), "scene": F.col("id"), "project_assets": F.col("asset_id") * 10 + F.col("project_id"),
        "library": F.substring("slug", 4, 18).cast("bigint"), "policy": F.substring("library_slug", 4, 18).cast("bigint"),
    }
    return _keys(left, keys)


def _keys(tables: dict[str, DataFrame], keys: dict) -> DataFrame:
    parts = [tables[n].select(F.lit(n).alias("table_name"), k.alias("key")) for n, k in keys.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("orphan_delete", """select 'asset' as table_name, id as key from asset where library_id in (select slug from library)
union all select 'scene', id from scene where asset_id not in (select id from asset where library_id not in (select slug from library))""")
def orphan_delete(c: Catalog) -> DataFrame:
    left = life.delete_orphans(c.library, {"asset": c.asset, "scene": c.scene})
    return _keys(left, {"asset": F.col("id"), "scene": F.col("id")})


@query("project_add", f"""select project_id, asset_id from project_assets
union select p.id, a.id from (select doc_id*2 as id, quality+2 as pid from {{labels}}) l join project p on p.id=l.pid join asset a on a.id=l.id where a.{o.LIVE}""")
def project_add(c: Catalog) -> DataFrame:
    """Every labelled live asset added to one of two projects; repeats change nothing."""
    labels = c.spark.read.parquet(f"{c.sf_dir}/labels.parquet")
    wanted = labels.select((F.col("quality") + 2).cast("bigint").alias("project_id"), (F.col("doc_id") * 2).alias("asset_id"))
    return life.add_to_projects(c.project_assets, wanted, c.project, live_assets(c.asset, c.library))


@query("reindex_videos", f"""select 'scene' as table_name, id as key, null as status, null as preview_path, null::bigint as retry_count from scene where asset_id not in
  (select id from asset where type='video' and library_id='src4' and {o.LIVE})
union all select 'asset', id, case when v then 'pending' else status end, case when not v then preview_path end, retry_count
from (select *, type='video' and library_id='src4' and {o.LIVE} as v from asset) q""")
def reindex_videos(c: Catalog) -> DataFrame:
    left = life.reindex_library(c.library, {"asset": c.asset, "scene": c.scene}, "src4")
    none = F.lit(None).cast("string")
    scenes = left["scene"].select(
        F.lit("scene").alias("table_name"), F.col("id").alias("key"), none.alias("status"),
        none.alias("preview_path"), F.lit(None).cast("bigint").alias("retry_count"),
    )
    return scenes.unionByName(left["asset"].select(
        F.lit("asset").alias("table_name"), F.col("id").alias("key"), "status", "preview_path", "retry_count"
    ))


@query("resegment_stale", f"""select id, case when stale then 'pending' else status end as status, case when not stale then preview_path end as preview_path,
  case when stale then 0 else (select count(*) from scene s where s.asset_id=a.id) end as scenes
from (select *, type='video' and {o.LIVE} and {o.READY} and {o.IS_VIDEO} and coalesce(segmentation_version,513000)<>513000
  and exists(select 1 from source_file f where f.library_id=b.library_id and f.rel_path=b.rel_path) as stale from asset b) a""")
def resegment_stale(c: Catalog) -> DataFrame:
    """Videos cut by outdated rules sent back, unless their source is gone."""
    ids = mt.resegmentable(c.asset, c.library, c.source_file)
    left = life.reindex_videos(ids, {"asset": c.asset, "scene": c.scene})
    scenes = left["scene"].groupBy(F.col("asset_id").alias("id")).agg(F.count("*").alias("n"))
    return left["asset"].join(scenes, "id", "left").select(
        "id", "status", "preview_path", F.coalesce("n", F.lit(0)).alias("scenes")
    )


_POLICY = "library_slug, active_index_name, shadow_index_name, previous_index_name, locked, locked_epoch, promotion_progress"


def _policies(policy: DataFrame) -> DataFrame:
    return policy.withColumn("locked_epoch", F.unix_seconds("locked_since")).select(*_POLICY.split(", "))


@query("policy_promote", """select library_slug, case when shadow_index_name is not null then shadow_index_name else active_index_name end as active_index_name,
  null::varchar as shadow_index_name, case when shadow_index_name is not null then active_index_name else previous_index_name end as previous_index_name,
  case when shadow_index_name is null then locked else false end as locked, case when shadow_index_name is null then locked_epoch end as locked_epoch,
  case when shadow_index_name is not null then 1.0 else promotion_progress end::double as promotion_progress from policy""")
def policy_promote(c: Catalog) -> DataFrame:
    return _policies(life.promote(c.policy))


@query("policy_rollback", """select library_slug, case when p then previous_index_name else active_index_name end as active_index_name,
  case when p then active_index_name else shadow_index_name end as shadow_index_name, null::varchar as previous_index_name,
  case when p then false else locked end as locked, case when not p then locked_epoch end as locked_epoch,
  case when p then 1.0 else promotion_progress end::double as promotion_progress from (select *, previous_index_name is not null as p from policy) q""")
def policy_rollback(c: Catalog) -> DataFrame:
    return _policies(life.rollback(c.policy))


@query("policy_shadow", f"""select library_slug, active_index_name, case when library_slug='src3' then 'media_scenes_src3_300' else shadow_index_name end as shadow_index_name,
  previous_index_name, locked or library_slug='src3' as locked, case when library_slug='src3' then {AS_OF} else locked_epoch end as locked_epoch,
  case library_slug when 'src3' then 0.0 when 'src1' then 1.0 else promotion_progress end::double as promotion_progress from policy""")
def policy_shadow(c: Catalog) -> DataFrame:
    """One library starts a shadow index; another reports progress beyond the end."""
    started = life.begin_shadow(c.policy, "src3", "media_scenes_src3_300", AS_OF)
    return _policies(life.set_progress(started, "src1", 7.5))


@query("policy_first_run", f"""select {_POLICY} from policy union all
select distinct library_id, 'media_scenes_'||library_id||'_{AS_OF}', null, null, false, null, 0.0::double from asset
where status='completed' and library_id not in (select library_slug from policy)""")
def policy_first_run(c: Catalog) -> DataFrame:
    """Policies after the first index run over the libraries with completed assets."""
    done = c.asset.where(F.col("status") == "completed").select(F.col("library_id").alias("library_slug"))
    return _policies(life.first_policies(c.policy, done, AS_OF))
