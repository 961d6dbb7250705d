"""Lookups, listings and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators import catalog as cat
from scenelake.operators.lifecycle import export_manifest
from scenelake.plans import oracle_parts as o
from scenelake.plans.registry import query
from scenelake.plans.tables import AS_OF, SYSTEM_DEFAULT_MODEL, Catalog
from scenelake.schemas import IMAGE_SUFFIXES, SEGMENTATION_VERSION

_ASSET = "id, library_id, rel_path, type, mtime, size, status"


def _brief(df: DataFrame) -> DataFrame:
    return df.select(*_ASSET.split(", "))


@query("live_assets", f"select {_ASSET} from asset where {o.LIVE}")
def live_assets(c: Catalog) -> DataFrame:
    return _brief(cat.live_assets(c.asset, c.library))


@query("asset_lookup", f"select {_ASSET} from asset where {o.LIVE} and library_id='src1' and rel_path like '%/doc_1.%'")
def asset_lookup(c: Catalog) -> DataFrame:
    """One asset by library and path; the path is that of document 1."""
    path = c.flat("image_asset").where(F.col("id") == 2).select("rel_path").first()
    return _brief(cat.asset_by_path(c.asset, c.library, "src1", path[0]))


@query("asset_with_library", f"select a.{_ASSET.replace(', ', ', a.')}, l.absolute_path from asset a join library l on a.library_id=l.slug where l.deleted_epoch is null")
def asset_with_library(c: Catalog) -> DataFrame:
    return cat.assets_with_library(c.asset, c.library).select(*_ASSET.split(", "), "absolute_path")


@query("assets_by_ids", f"select {_ASSET} from asset where {o.LIVE} and id in (select doc_id*2 from {{labels}} where toxic=1)")
def assets_by_ids(c: Catalog) -> DataFrame:
    """Assets of the documents labelled toxic."""
    labels = c.spark.read.parquet(f"{c.sf_dir}/labels.parquet").where("toxic = 1")
    return _brief(cat.assets_by_ids(c.asset, c.library, labels.select((F.col("doc_id") * 2).alias("id"))))


def _listing(slug: str, order: str, limit: int, offset: int) -> str:
    return f"select {_ASSET} from asset where {o.LIVE} and library_id='{slug}' order by {order} limit {limit} offset {offset}"


@query("browse_library", f"""select * from (select 'date' as listing, * from ({_listing('src2', 'mtime desc, id', 20, 5)})
union all select 'type', * from ({_listing('src2', 'type, rel_path desc, id', 20, 0)})
union all select 'name', * from ({_listing('src2', 'rel_path, id', 20, 10)})) q""")
def browse_library(c: Catalog) -> DataFrame:
    """Three listings of a library: newest first, by type, and a later page by name."""
    def page(name: str, **how) -> DataFrame:
        rows = _brief(cat.browse(c.asset, c.library, "src2", limit=20, **how))
        return rows.select(F.lit(name).alias("listing"), "*")

    return page("date", offset=5).unionByName(page("type", sort_by="type")).unionByName(
        page("name", sort_by="name", order="asc", offset=10)
    )


@query("browse_page", f"""select q.*, (select count(*) from asset where {o.LIVE} and library_id='src3')>10 as has_more
from ({_listing('src3', 'size desc, id', 10, 0)}) q""")
def browse_page(c: Catalog) -> DataFrame:
    page = cat.browse_page(c.asset, c.library, "src3", limit=10, sort_by="size")
    return page.select(*_ASSET.split(", "), "has_more")


@query("recent_assets", f"""select {_ASSET}, (select count(*) from asset where library_id='src6' and status='completed') as total
from asset where library_id='src6' and status='completed' order by id desc limit 15""")
def recent_assets(c: Catalog) -> DataFrame:
    rows = cat.assets_of_library(c.asset, "src6", "completed", limit=15)
    total = cat.assets_of_library(c.asset, "src6", "completed").agg(F.count("*")).scalar()
    return _brief(rows).withColumn("total", total)


@query("completed_after", f"select {_ASSET} from asset where {o.LIVE} and status='completed' and id>100 order by id limit 100")
def completed_after(c: Catalog) -> DataFrame:
    return _brief(cat.completed_after(c.asset, c.library, cursor=100, limit=100))


@query("video_ids", f"select id from asset where {o.LIVE} and type='video'")
def video_ids(c: Catalog) -> DataFrame:
    return cat.video_ids(c.asset, c.library)


@query("stale_segmentation", f"""select id, segmentation_version, exists(select 1 from source_file f where f.library_id=a.library_id and f.rel_path=a.rel_path) as has_source
from asset a where {o.LIVE} and {o.READY} and type='video' and {o.IS_VIDEO} and segmentation_version<>{SEGMENTATION_VERSION}""")
def stale_segmentation(c: Catalog) -> DataFrame:
    present = c.source_file.select("library_id", "rel_path", F.lit(True).alias("seen"))
    rows = cat.stale_segmentation(c.asset, c.library).join(present, ["library_id", "rel_path"], "left")
    return rows.select("id", "segmentation_version", F.coalesce("seen", F.lit(False)).alias("has_source"))


@query("effective_model", f"""select slug, coalesce(target_tagger_id,{SYSTEM_DEFAULT_MODEL}) as model_id,
  (select count(*) from asset a where a.library_id=slug) as assets from library where deleted_epoch is null""")
def effective_model(c: Catalog) -> DataFrame:
    """Model each live library wants, with the number of assets it applies to."""
    models = cat.library_models(c.library, SYSTEM_DEFAULT_MODEL)
    sizes = c.asset.groupBy(F.col("library_id").alias("slug")).agg(F.count("*").alias("n"))
    return models.join(sizes, "slug", "left").select("slug", "model_id", F.coalesce("n", F.lit(0)).alias("assets"))


@query("expecting_reanalysis", f"""select a.id, a.library_id, a.analysis_model_id, coalesce(l.target_tagger_id,{SYSTEM_DEFAULT_MODEL}) as model_id
from asset a join library l on l.slug=a.library_id where deleted_epoch is null and status in ('completed','analyzed_light','analyzing')
and {o.IS_IMAGE} and analysis_model_id is distinct from coalesce(l.target_tagger_id,{SYSTEM_DEFAULT_MODEL})""")
def expecting_reanalysis(c: Catalog) -> DataFrame:
    rows = cat.expecting_reanalysis(c.asset, c.library, SYSTEM_DEFAULT_MODEL)
    return rows.select("id", "library_id", "analysis_model_id", "model_id")


_WORK = f"(status='proxied' or (status='processing' and lease_epoch<{AS_OF})) and {o.IS_IMAGE}"


@query("eligible_work", f"""select 'image_analysis' as stage, id, library_id, status from asset a where {_WORK} and {o.LIVE}
  and library_id in (select slug from library where coalesce(target_tagger_id,{SYSTEM_DEFAULT_MODEL})=1)
union all select 'exif', id, library_id, status from asset where metadata_status is null and {o.IS_MEDIA} and {o.LIVE}
union all select 'sharpness', id, library_id, status from asset where metadata_status='exif_done' and {o.IS_MEDIA} and {o.LIVE}""")
def eligible_work(c: Catalog) -> DataFrame:
    """Work waiting for image analysis with model 1, for raw metadata and for sharpness."""
    def stage(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("stage"), "id", "library_id", "status")

    images = cat.eligible_work(
        c.asset, c.library, "proxied", IMAGE_SUFFIXES, AS_OF, target_model=1,
        default_model=SYSTEM_DEFAULT_MODEL,
    )
    out = stage("image_analysis", images)
    for name in ("exif", "sharpness"):
        out = out.unionByName(stage(name, cat.eligible_metadata(c.asset, c.library, name)))
    return out


@query("latest_model", "select name, max(id) as id, max_by(version, id) as version from aimodel group by name")
def latest_model(c: Catalog) -> DataFrame:
    return cat.latest_models(c.aimodel)


@query("libraries", "select slug, coalesce(name, slug) as name, scan_status, deleted_epoch is not null as trashed from library")
def libraries(c: Catalog) -> DataFrame:
    """Live and trashed libraries."""
    def part(rows: DataFrame, trashed: bool) -> DataFrame:
        return rows.select("slug", F.coalesce("name", "slug").alias("name"), "scan_status", F.lit(trashed).alias("trashed"))

    return part(cat.list_libraries(c.library), False).unionByName(part(cat.trashed_libraries(c.library), True))


@query("asset_paths_flag", f"""select id, library_id, rel_path, exists(select 1 from project_assets p where p.asset_id=a.id) as is_in_project
from asset a where {o.LIVE}""")
def asset_paths_flag(c: Catalog) -> DataFrame:
    return cat.asset_paths(c.asset, c.library, c.project_assets)


@query("orphan_libraries", "select library_id, count(*) as assets from asset where not exists (select 1 from library where slug=library_id) group by 1")
def orphan_libraries(c: Catalog) -> DataFrame:
    return cat.orphan_libraries(c.asset, c.library)


_PATHS = """select p.project_id, a.id as asset_id, l.absolute_path||'/'||a.rel_path as path from project_assets p
join asset a on a.id=p.asset_id join library l on l.slug=a.library_id where l.deleted_epoch is null"""


@query("project_paths", _PATHS)
def project_paths(c: Catalog) -> DataFrame:
    return cat.project_paths(c.project_assets, c.asset, c.library)


@query(
    "project_export_manifest",
    """select project_id, asset_id, path, case when copy=1 then name else stem||'_'||(copy)||ext end as dest_name
from (select *, row_number() over (partition by project_id, name order by asset_id) as copy,
        regexp_extract(name,'^(.*[^.])(\\.[^.]+)$',1) as stem, regexp_extract(name,'^.*[^.](\\.[^.]+)$',1) as ext
      from (select *, regexp_extract(path,'[^/]*$') as name from paths) q) r""",
    {"paths": _PATHS},
)
def project_export_manifest(c: Catalog) -> DataFrame:
    return export_manifest(c.project_assets, c.asset, c.library)


@query("projects", """select id, name, created_epoch, (select count(*) from project_assets p where p.project_id=id) as members from project""")
def projects(c: Catalog) -> DataFrame:
    """Projects, newest first, with their number of members."""
    sizes = c.project_assets.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("members"))
    rows = c.project.join(sizes, "id", "left").withColumn("members", F.coalesce("members", F.lit(0)))
    return cat.list_projects(rows).select(
        "id", "name", F.unix_seconds("created_at").alias("created_epoch"), "members"
    )


@query("list_scenes", "select id, asset_id, start_ts, end_ts, description, sharpness_score, rep_frame_path, keep_reason from scene")
def list_scenes(c: Catalog) -> DataFrame:
    return cat.list_scenes(c.scene).select(
        "id", "asset_id", "start_ts", "end_ts", "description", "sharpness_score", "rep_frame_path", "keep_reason"
    )


@query("first_rep_frame", """select asset_id, rep_frame_path from (select asset_id, first(rep_frame_path order by start_ts, id) as rep_frame_path
from scene group by 1) q where rep_frame_path<>''""")
def first_rep_frame(c: Catalog) -> DataFrame:
    return cat.first_scene_frames(c.scene)


@query("assets_with_scenes", f"select id, library_id from asset where {o.LIVE} and id in (select asset_id from scene)")
def assets_with_scenes(c: Catalog) -> DataFrame:
    return cat.assets_with_scenes(c.scene, c.asset, c.library)


@query("assets_with_scenes_page", f"select id, library_id from asset where {o.LIVE} and id in (select asset_id from scene) and id>41 order by id limit 25 offset 10")
def assets_with_scenes_page(c: Catalog) -> DataFrame:
    """One page, behind an id and then some."""
    return cat.assets_with_scenes(c.scene, c.asset, c.library, limit=25, offset=10, after=41)


@query("scene_progress", """select asset_id, max(end_ts) as max_end_ts,
  first(description order by end_ts desc, id desc) as last_description from scene group by asset_id""")
def scene_progress(c: Catalog) -> DataFrame:
    return cat.scene_progress(c.scene)


def moments(c: Catalog) -> DataFrame:
    """A moment every 17 seconds of the videos that frames were seen for."""
    step = F.floor(F.col("pts") / 17)
    return c.frame.select("asset_id", (step * 17.0 + 3.5).alias("ts")).distinct()


_MOMENTS = "select distinct asset_id, cast(floor(pts/17)*17.0+3.5 as double) as ts from frame"


@query(
    "nearest_scene",
    """select m.asset_id, m.ts, s.id as scene_id, s.start_ts, s.tag from moments m join scene s on s.asset_id=m.asset_id and s.has_analysis
qualify row_number() over (partition by m.asset_id, m.ts order by abs(s.start_ts-m.ts), s.start_ts, s.id)=1""",
    {"moments": _MOMENTS},
)
def nearest_scene(c: Catalog) -> DataFrame:
    found = cat.nearest_scene(c.scene, moments(c), chunk_seconds=30.0)
    return found.select("asset_id", "ts", "scene_id", "start_ts", F.col("analysis.tags")[0].alias("tag"))


@query(
    "asset_detail",
    f"""select m.asset_id, m.ts, s.description, coalesce(s.tag,'') as tags, s.ocr_text, a.library_id as library_slug, {o.BASENAME} as filename
from asset a join moments m on m.asset_id=a.id left join near s on s.asset_id=m.asset_id and s.ts=m.ts where a.{o.LIVE}
union all
select id, null, description, coalesce(tag1||'|'||tag2,''), ocr_text, library_id, {o.BASENAME} from asset where {o.LIVE}""",
    {"moments": _MOMENTS, "near": """select m.asset_id, m.ts, s.description, s.tag, s.ocr_text from moments m join scene s on s.asset_id=m.asset_id and s.has_analysis
qualify row_number() over (partition by m.asset_id, m.ts order by abs(s.start_ts-m.ts), s.start_ts, s.id)=1"""},
)
def asset_detail(c: Catalog) -> DataFrame:
    """Details of every asset, and of videos at many moments."""
    plain = c.asset.select(F.col("id").alias("asset_id"), F.lit(None).cast("double").alias("ts"))
    asked = moments(c).unionByName(plain)
    rows = cat.asset_detail(c.asset, c.library, c.scene, asked)
    return rows.withColumn("tags", F.array_join("tags", "|"))
