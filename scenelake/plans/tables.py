"""Catalog tables derived from the given Parquet tables.

Each table is one portable SELECT, run unchanged by Spark and by the DuckDB oracles; only the raw
table references and the two timestamp functions differ, filled in through `{...}` placeholders.
Times are epoch seconds here; `Catalog` turns them into timestamps and nested columns.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions import exif
from scenelake.functions.paths import suffix
from scenelake.operators.geo import reverse_geocode
from scenelake.operators.workers import latest_heartbeat
from scenelake.session import run_folder, store
from scenelake.sources import text_index as ti
from scenelake.sources.search_docs import (
    build_documents, build_postings, read_documents, with_index, write_documents, write_postings,
)

AS_OF = 1706659199  # 2024-01-30 23:59:59 UTC, the "now" of every registered query
SYSTEM_DEFAULT_MODEL = 1

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_STATUS = """case {k}%13 when 0 then 'pending' when 1 then 'processing' when 2 then 'proxied'
  when 3 then 'analyzed_light' when 4 then 'failed' when 5 then 'poisoned' when 6 then 'extracting'
  when 7 then 'analyzing' else 'completed' end"""

TABLES: dict[str, str] = {}

TABLES["library"] = """
select slug, case when n%6=5 then null else 'Library '||upper(slug) end as name,
  '/mnt/'||slug as absolute_path, n%10<>9 as is_active,
  case when n%5=1 then 'scanning' when n%5=2 then 'full_scan_requested' else 'idle' end as scan_status,
  cast(case when n%4=0 then 2 end as bigint) as target_tagger_id, cast(100 as bigint) as sampling_limit,
  cast(case when n%7=6 then 1706000000+n*1000 end as bigint) as deleted_epoch
from (select distinct source as slug, coalesce(try_cast(substr(source,4) as bigint),0) as n from {documents}) q
"""

TABLES["aimodel"] = """
select s_suppkey+1 as id, 'analyzer-'||cast(s_nationkey as varchar(20)) as name,
  'v'||cast(s_suppkey as varchar(20)) as version
from {supplier}
"""

TABLES["image_asset"] = """
select k*2 as id, case when k%97=5 then 'lost-'||cast(k%3 as varchar(20)) else source end as library_id,
  lang||'/'||case when k%9=0 then 'shot_'||cast(k%4 as varchar(20)) else 'doc_'||cast(k as varchar(20)) end
    ||case when k%9=0 then '/' ||cast(k as varchar(20))||'/frame' else '' end
    ||case k%6 when 0 then '.jpg' when 1 then '.JPG' when 2 then '.cr2' when 3 then '.png'
       when 4 then '.tiff' else '.txt' end as rel_path,
  'image' as type, cast(1700000000+(k*37)%1000000 as double) as mtime, n_chars as size,
  """ + _STATUS.replace("{k}", "k") + """ as status,
  cast(case when k%5<3 then k%30+1 end as bigint) as tags_model_id,
  cast(case k%4 when 0 then 1 when 1 then 2 when 2 then k%30+1 end as bigint) as analysis_model_id,
  case when k%13=1 then 'w'||cast(k%150 as varchar(20)) end as worker_id,
  cast(case when k%13=1 and k%26<>1 then 1706658599+(k%5)*300 end as bigint) as lease_epoch,
  k%8 as retry_count,
  case when k%13 in (4,5) then 'decode error '||cast(k%3 as varchar(20)) end as error_message,
  k%9<>4 as has_analysis,
  case when k%9<>4 then text end as description,
  case when k%9<>4 and k%3=0 then text end as ocr_text,
  case when k%9<>4 then lang end as tag1, case when k%9<>4 then source end as tag2,
  case when k%4=0 then source||'/previews/'||cast(k*2 as varchar(20))||'.jpg' end as preview_path,
  cast(null as varchar(200)) as video_preview_path, cast(null as bigint) as segmentation_version,
  case k%5 when 1 then 'exif_processing' when 2 then 'exif_done' when 3 then 'sharpness_processing'
    when 4 then 'complete' end as metadata_status
from (select doc_id as k, text, lang, source, n_chars from {documents}) d
"""

TABLES["video_asset"] = """
select k*2+1 as id, 'src'||cast(k%20 as varchar(20)) as library_id,
  'clips/'||case when k%6=0 then 'take_'||cast(k as varchar(20))||'/scene' else 'conv_'||cast(k as varchar(20)) end
    ||case k%3 when 0 then '.mp4' when 1 then '.MOV' else '.mkv' end as rel_path,
  'video' as type, cast(1700500000+(k*91)%1000000 as double) as mtime, n_bytes as size,
  """ + _STATUS.replace("{k}", "(k+8)") + """ as status,
  cast(case when k%5<3 then k%30+1 end as bigint) as tags_model_id,
  cast(case k%4 when 0 then 1 when 1 then 2 when 2 then k%30+1 end as bigint) as analysis_model_id,
  case when (k+8)%13=1 then 'w'||cast(k%150 as varchar(20)) end as worker_id,
  cast(case when (k+8)%13=1 then 1706658599+(k%5)*300 end as bigint) as lease_epoch,
  k%8 as retry_count,
  case when (k+8)%13 in (4,5) then 'probe error' end as error_message,
  false as has_analysis, cast(null as varchar(200)) as description,
  cast(null as varchar(200)) as ocr_text, cast(null as varchar(200)) as tag1,
  cast(null as varchar(200)) as tag2,
  case when k%4=0 then 'src'||cast(k%20 as varchar(20))||'/previews/'||cast(k*2+1 as varchar(20))||'.jpg' end as preview_path,
  case when k%2=0 then 'video_clips/src'||cast(k%20 as varchar(20))||'/'||cast(k*2+1 as varchar(20))||'/head_clip.mp4' end as video_preview_path,
  cast(case k%4 when 0 then null when 1 then 513000 else 483000 end as bigint) as segmentation_version,
  case k%5 when 1 then 'exif_processing' when 2 then 'exif_done' when 3 then 'sharpness_processing'
    when 4 then 'complete' end as metadata_status
from (select conv_id as k, cast(sum(length(text)) as bigint) as n_bytes from {conversations} group by conv_id) c
"""

TABLES["asset"] = "select * from image_asset union all select * from video_asset"

TABLES["scene"] = """
select conv_id*1000000+turn as id, conv_id*2+1 as asset_id, cast(turn*10 as double) as start_ts,
  cast(turn*10+1+length(text)%10 as double) as end_ts,
  case when (conv_id+turn)%7<>3 then text end as description,
  (conv_id+turn)%7<>3 as has_analysis,
  case when (conv_id+turn)%7<>3 then role end as tag,
  case when (conv_id+turn)%7<>3 and (conv_id+turn)%3=0 then text end as ocr_text,
  (conv_id+turn)%7<>3 and (conv_id+turn)%5<>0 as ocr_done,
  cast(length(text)%97 as double)/10 as sharpness_score,
  case when turn%5=4 then '' else 'video_scenes/src'||cast(conv_id%20 as varchar(20))||'/'
    ||cast(conv_id*2+1 as varchar(20))||'/'||cast(turn*10 as varchar(20))||'.jpg' end as rep_frame_path,
  case turn%3 when 0 then 'phash' when 1 then 'temporal' else 'forced' end as keep_reason
from {conversations}
"""

# One frame per event: presentation time is the event time on a compressed clock, so spacing is uneven.
TABLES["frame"] = """
select event_id as frame_id, user_id*2+1 as asset_id, pts, value as sharpness,
  substr('0123456789abcdef', cast(event_id%16 as int)+1, 1)
    ||substr(md5('a'||cast(user_id as varchar(20))||'-'||cast(block as varchar(20))),2)
    ||md5('b'||cast(user_id as varchar(20))||'-'||cast(block as varchar(20))) as phash
from (
  select event_id, user_id, value, cast(ms as double)/1000 as pts,
    cast(floor(ms/(case when user_id%5=0 then 47000 else 5000+user_id%7*2500 end)) as bigint) as block
  from (select event_id, user_id, value, cast(floor(({ts_us}-1704067200000000)/12000000) as bigint) as ms
        from {events}) e1
) e2
"""

# A heartbeat per event, on a clock compressed towards AS_OF so that some workers count as active.
TABLES["heartbeat"] = """
select event_id, 'w'||cast(user_id as varchar(20)) as worker_id,
  'host'||cast(user_id%10 as varchar(20)) as hostname,
  1706659199 - cast(floor((1706659199000000-{ts_us})/200000000) as bigint)
    - case when user_id%17=0 then 172800 else 0 end as seen_epoch,
  case event_type when 'view' then 'idle' when 'error' then 'offline' when 'signup' then 'paused'
    else 'processing' end as state,
  case when event_type='view' then null when value<60 then 'transcode' else 'thumbnail' end as stage,
  value as progress
from {events}
"""

TABLES["worker"] = """
select worker_id, hostname, seen_epoch, state, stage from (
  select h.*, row_number() over (partition by worker_id order by seen_epoch desc, event_id desc) as rn
  from heartbeat h) q where rn = 1
"""

TABLES["project"] = """
select id, case when id=4 then '*** ***' else 'Spring Shoot #'||cast(id as varchar(20))||' (A)' end as name,
  cast(1706000000+(id*7)%3*100 as bigint) as created_epoch, cast(null as varchar(200)) as export_path
from (select distinct doc_id%5 as id from {labels}) q
"""

TABLES["project_assets"] = """
select doc_id%5 as project_id, doc_id*2 as asset_id from {labels} where quality=1
union all
select distinct conv_id%5, conv_id*2+1 from {conversations} where conv_id%4=0
"""

TABLES["policy"] = """
select slug as library_slug, case when n%11=10 then null else 'media_scenes_'||slug||'_100' end as active_index_name,
  case when n%4=1 then 'media_scenes_'||slug||'_200' end as shadow_index_name,
  case when n%5=3 then 'media_scenes_'||slug||'_50' end as previous_index_name,
  n%4=1 as locked, cast(case when n%4=1 then 1706600000+n end as bigint) as locked_epoch,
  cast(case when n%4=1 then 0.5 else 1.0 end as double) as promotion_progress
from (select distinct source as slug, coalesce(try_cast(substr(source,4) as bigint),0) as n from {documents}) q
where n%3<>2
"""

# Raw camera metadata, one row per asset; null means the key is absent.
TABLES["exif"] = """
select id, type, mtime, '/x/'||rel_path as source_file, 'blob'||cast(k as varchar(20)) as maker_note,
  'S'||cast(k*7919 as varchar(20)) as serial_number,
  case k%7 when 0 then null when 1 then '2024:13:40 99:00:00' when 2 then 'garbage'
    else '2023:0'||cast(1+k%9 as varchar(20))||':1'||cast(k%10 as varchar(20))||' 1'||cast(k%10 as varchar(20))||':05:0'||cast(k%6 as varchar(20)) end as date_time_original,
  case when k%7=1 then '2022:05:0'||cast(1+k%9 as varchar(20))||' 01:02:03' end as create_date,
  case k%5 when 0 then '+02:00' when 1 then '-05:30' when 2 then '03:00' when 3 then 'bogus' end as offset_time_original,
  case k%4 when 0 then '  Canon ' when 1 then 'NIKON' when 2 then '   ' end as make,
  case k%3 when 0 then ' ' when 1 then 'Z'||cast(k%5 as varchar(20)) end as model,
  case when k%2=0 then ' R5 ' end as camera_model_name,
  case when k%10=7 then 'FX'||cast(k%3 as varchar(20)) end as device_model_name,
  case when k%8=3 then 'Display P3 v4' when k%8=4 then 'sRGB IEC' end as icc_profile_name,
  case k%6 when 0 then '1' when 1 then '2' when 2 then 'uncal' when 3 then '65535' end as color_space,
  case k%5 when 1 then 'bt.709' when 2 then 'BT2020-10' when 3 then 'smpte' end as color_primaries,
  case k%5 when 0 then '30000/1001' when 1 then ' ' when 2 then '25' when 3 then 'x/2' end as video_frame_rate,
  case k%3 when 0 then '24/0' when 1 then '59.94' end as avg_frame_rate,
  case k%6 when 0 then '0:01:30' when 1 then '02:15.5' when 2 then '33.25' when 3 then 'a:b' when 4 then '' end as duration,
  case k%4 when 0 then '1920' when 1 then 'wide' when 2 then ' 4000.7 ' end as exif_image_width,
  case when k%3<>2 then '3840' end as image_width,
  case k%4 when 0 then '1080' when 3 then '2160' end as image_height,
  case when k%9=4 then 'S-Log3' when k%9=5 then 'Rec709' end as gamma_curve,
  case k%5 when 0 then cast(k*100000 as varchar(20)) when 1 then ' 900000 ' when 2 then '99000000' when 3 then 'fast' end as video_bitrate,
  case when k%6=5 then 'n/a' when k%6<4 then cast(cast((k*37)%1700 as double)/10-85 as varchar(20)) end as gps_latitude,
  case when k%6<5 then cast(cast((k*53)%3500 as double)/10-175 as varchar(20)) end as gps_longitude
from (select id, type, mtime, rel_path, cast(floor(id/2) as bigint) as k from asset) a
"""

TABLES["gazetteer"] = """
select s_suppkey as place_id, cast((s_suppkey*97)%1600 as double)/10-80 as lat,
  cast((s_suppkey*211)%3600 as double)/10-180 as lon, n_name as country, r_name as region, s_name as city
from {supplier} s join {nation} n on s.s_nationkey=n.n_nationkey join {region} r on n.n_regionkey=r.r_regionkey
"""

# Files of the last walk over the library roots: some missing, some touched, some new.
TABLES["source_file"] = """
select library_id, rel_path, type, case when k%10=3 then mtime+5 else mtime end as mtime,
  case when k%15=7 then size+1 else size end as size
from (select library_id, rel_path, type, mtime, size, cast(floor(id/2) as bigint) as k from asset) a
where k%12<>11
union all
select 'src'||cast(page_id%20 as varchar(20)), 'new/page_'||cast(page_id as varchar(20))||case page_id%3 when 0 then '.png' else '.mp4' end,
  case page_id%3 when 0 then 'image' else 'video' end, cast(1706000000+page_id as double), cast(length(html) as bigint)
from {pages}
"""

# Files under the data directory: derivatives (some lost, some empty) plus strays, clips and temp files.
TABLES["data_file"] = """
select library_id||'/thumbnails/'||cast(id%1000 as varchar(20))||'/'||cast(id as varchar(20))||'.jpg' as path,
  1706000000.0e0 as mtime, case when k%14=3 then 0 else 1000+k%50 end as size
from (select library_id, id, cast(floor(id/2) as bigint) as k from asset) a where k%13<>0
union all
select library_id||'/proxies/'||cast(id%1000 as varchar(20))||'/'||cast(id as varchar(20))||'.jpg', 1706000000.0e0, 5000+k%50
from (select library_id, id, type, cast(floor(id/2) as bigint) as k from asset) b where k%11<>0 and type='image'
union all
select 'video_clips/'||library_id||'/'||cast(id as varchar(20))||'/head_clip.mp4', 1706000000.0e0, case when k%9=2 then 0 else 9000+k%50 end
from (select library_id, id, type, cast(floor(id/2) as bigint) as k from asset) c where type='video' and k%7<>0
union all
select 'video_clips/'||library_id||'/'||cast(id as varchar(20))||'/clip_5000.mp4', 1706658000.0e0+k, 700
from (select library_id, id, type, cast(floor(id/2) as bigint) as k from asset) d where type='video' and k%3=0
union all
select rep_frame_path, 1706000000.0e0, 300 from scene where rep_frame_path<>'' and id%17<>0
union all
select 'src'||cast(page_id%20 as varchar(20))||case page_id%2 when 0 then '/thumbnails/9/stray_' else '/proxies/9/stray_' end
  ||cast(page_id as varchar(20))||'.jpg', 1706659199.0e0-page_id*30, cast(length(html) as bigint) from {pages}
union all
select 'tmp/src'||cast(page_id%20 as varchar(20))||'/part_'||cast(page_id as varchar(20)), 1706659199.0e0-page_id*20,
  cast(length(html) as bigint) from {pages}
"""

_SPARK_TS = "unix_micros(cast(ts as timestamp))"
_DUCK_TS = "epoch_us(ts)"


def _needed(body: str) -> list[str]:
    """Derived tables a query text mentions, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_]+", text))
        for name in TABLES:
            if name in words and name not in found:
                visit(TABLES[name].replace("{" + name + "}", ""))
                if name not in found:
                    found.append(name)

    visit(body)
    return found


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query body with the CTEs it uses; placeholders are left in."""
    ctes = {name: TABLES[name] for name in _needed(" ".join([body, *(extra or {}).values()]))}
    ctes.update(extra or {})
    if not ctes:
        return body
    return "with " + ",\n".join(f"{n} as ({q.strip()})" for n, q in ctes.items()) + "\n" + body


def _fill(sql: str, refs: dict[str, str]) -> str:
    for name, ref in refs.items():
        sql = sql.replace("{" + name + "}", ref)
    return sql


def duckdb_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: CTEs plus body over the registered views."""
    sql = _fill(with_tables(body, extra), {**{r: r for r in RAW}, "ts_us": _DUCK_TS})
    recursive = any(re.search(rf"\b{name}\b", text) for name, text in (extra or {}).items())
    return sql.replace("with ", "with recursive ", 1) if recursive else sql


def _epoch_to_ts(name: str):
    return F.timestamp_seconds(F.col(name))


class Catalog:
    """Typed catalog tables over one data directory.

    Each table is derived with Spark on first use and stored in the shared folder, as the snapshot
    tables of a catalog are; queries then run on stored tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.root = f"{run_folder(spark)}/catalog-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._indexes: dict[str, ti.TextIndex] = {}

    def flat(self, name: str) -> DataFrame:
        """A derived table straight from the given tables, not stored."""
        refs = {r: f"parquet.`{self.sf_dir}/{r}.parquet`" for r in RAW}
        return self.spark.sql(
            _fill(with_tables(f"select * from {name}"), {**refs, "ts_us": _SPARK_TS})
        )

    def _stored(
        self, name: str, build: Callable[[], DataFrame], order: tuple[str, ...] = (), by: tuple[str, ...] = (), as_read: bool = False
    ) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = store(build(), f"{self.root}/{name}", order, by, as_read)
        return self._tables[name]

    @property
    def library(self) -> DataFrame:
        return self._stored("library", lambda: self.flat("library").withColumn(
            "deleted_at", _epoch_to_ts("deleted_epoch")).drop("deleted_epoch"))

    @property
    def policy(self) -> DataFrame:
        return self._stored("policy", lambda: self.flat("policy").withColumn(
            "locked_since", _epoch_to_ts("locked_epoch")).drop("locked_epoch"))

    @property
    def project(self) -> DataFrame:
        return self._stored("project", lambda: self.flat("project").withColumn(
            "created_at", _epoch_to_ts("created_epoch")).drop("created_epoch"))

    @property
    def aimodel(self) -> DataFrame:
        return self._stored("aimodel", lambda: self.flat("aimodel"))

    @property
    def project_assets(self) -> DataFrame:
        return self._stored("project_assets", lambda: self.flat("project_assets"))

    @property
    def gazetteer(self) -> DataFrame:
        return self._stored("gazetteer", lambda: self.flat("gazetteer"))

    @property
    def source_file(self) -> DataFrame:
        return self._stored("source_file", lambda: self.flat("source_file"))

    @property
    def data_file(self) -> DataFrame:
        return self._stored("data_file", lambda: self.flat("data_file"))

    @property
    def frame(self) -> DataFrame:
        return self._stored("frame", lambda: self.flat("frame"), as_read=True)

    @property
    def asset(self) -> DataFrame:
        return self._stored("asset", self._asset, ("library_id", "id"), ("library_id",))

    def _asset(self) -> DataFrame:
        analysis = F.when(
            F.col("has_analysis"),
            F.struct(
                "description",
                F.array("tag1", "tag2").alias("tags"),
                "ocr_text",
                F.lit(None).cast("string").alias("model_name"),
                F.lit(None).cast("string").alias("model_version"),
            ),
        )
        return (
            self.flat("asset")
            .withColumn("lease_expires_at", _epoch_to_ts("lease_epoch"))
            .withColumn("visual_analysis", analysis)
            .withColumn("ext", suffix(F.col("rel_path")))
            .drop("lease_epoch", "has_analysis", "description", "ocr_text", "tag1", "tag2")
        )

    @property
    def scene(self) -> DataFrame:
        return self._stored("scene", self._scene, ("asset_id", "start_ts"))

    def _scene(self) -> DataFrame:
        analysis = F.struct(
            F.struct("description", F.array("tag").alias("tags"), "ocr_text", "ocr_done").alias("analysis"),
            F.lit(None).cast("string").alias("showinfo"),
            F.lit(None).cast("boolean").alias("semantic_duplicate"),
        )
        return (
            self.flat("scene")
            .withColumn("metadata", F.when(F.col("has_analysis"), analysis))
            .drop("has_analysis", "tag", "ocr_text", "ocr_done")
        )

    @property
    def heartbeat(self) -> DataFrame:
        return self._stored("heartbeat", self._heartbeat, as_read=True)

    def _heartbeat(self) -> DataFrame:
        stats = F.when(
            F.col("stage").isNotNull(), F.create_map(F.lit("current_stage"), F.col("stage"))
        )
        return (
            self.flat("heartbeat")
            .withColumn("last_seen_at", _epoch_to_ts("seen_epoch"))
            .withColumn("stats", stats)
            .drop("seen_epoch", "stage")
        )

    @property
    def worker(self) -> DataFrame:
        """Latest heartbeat of each worker, by the same operator the stream uses."""
        return self._stored("worker", lambda: latest_heartbeat(self.heartbeat))

    @property
    def exif(self) -> DataFrame:
        """Assets' id, type, mtime and raw metadata as a string map without absent keys."""
        return self._stored("exif", self._exif)

    def _exif(self) -> DataFrame:
        pairs = F.create_map(
            *[x for col, key in EXIF_KEYS.items() for x in (F.lit(key), F.col(col))]
        )
        return self.flat("exif").select(
            "id", "type", "mtime",
            F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("raw_exif"),
        )

    @property
    def metadata(self) -> DataFrame:
        """(id, m): normalised metadata of every asset."""
        return self._stored("metadata", lambda: normalised_metadata(self.exif, self.gazetteer))

    @property
    def documents(self) -> DataFrame:
        """Search documents in the active index of their library, and again in its shadow index."""
        if "documents" not in self._tables:
            # Measured as well: the scope of similar assets asks for faces and sharpness.
            measured = F.col("m").withField("has_face", F.col("id") % 2 == 0).withField(
                "sharpness_score", F.col("id") % 100 / F.lit(100.0)
            )
            described = self.asset.join(self.metadata.select("id", measured.alias("media_metadata")), "id")
            docs = build_documents(described, self.scene, AS_OF)
            both = with_index(docs, self.policy).unionByName(
                with_index(docs, self.policy, "shadow_index_name")
            )
            write_documents(both, f"{self.root}/documents", "base")
            self._tables["documents"] = read_documents(self.spark, f"{self.root}/documents")
        return self._tables["documents"]

    @property
    def text_index(self) -> ti.TextIndex:
        """Positional postings of all analysed images and scenes."""
        if "words" not in self._indexes:
            path = f"{self.root}/text-index"
            ti.write_index(ti.build_postings(self.asset, self.scene), path)
            self._indexes["words"] = ti.read_index(self.spark, path)
        return self._indexes["words"]

    @property
    def tag_index(self) -> ti.TextIndex:
        """Postings of tags alone, for searches that look at nothing else."""
        if "tags" not in self._indexes:
            path = f"{self.root}/tag-index"
            ti.write_index(ti.build_postings(self.asset, self.scene, words=False), path)
            self._indexes["tags"] = ti.read_index(self.spark, path)
        return self._indexes["tags"]

    @property
    def stemmed_index(self) -> ti.TextIndex:
        """The same by stems."""
        if "stems" not in self._indexes:
            path = f"{self.root}/stemmed-index"
            ti.write_index(ti.build_postings(self.asset, self.scene, stems=True), path)
            self._indexes["stems"] = ti.read_index(self.spark, path, stemmed=True)
        return self._indexes["stems"]

    @property
    def postings(self) -> DataFrame:
        if "postings" not in self._tables:
            write_postings(build_postings(self.documents), f"{self.root}/postings", "base")
            self._tables["postings"] = read_documents(self.spark, f"{self.root}/postings")
        return self._tables["postings"]


def normalised_metadata(raw: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, m) from assets' raw metadata, places included."""
    lat, lon = exif.gps(F.col("raw_exif"))
    located = raw.select("id", "type", "mtime", "raw_exif", lat.alias("lat"), lon.alias("lon"))
    placed = reverse_geocode(located, gazetteer)
    value = exif.media_metadata(F.col("raw_exif"), F.col("type"), F.col("mtime"), F.col("place"))
    return placed.select("id", value.alias("m"))


# Metadata key of each flat `exif` column.
EXIF_KEYS = {
    "source_file": "SourceFile",
    "maker_note": "MakerNoteBlob",
    "serial_number": "SerialNumber",
    "date_time_original": "DateTimeOriginal",
    "create_date": "CreateDate",
    "offset_time_original": "OffsetTimeOriginal",
    "make": "Make",
    "model": "Model",
    "camera_model_name": "CameraModelName",
    "device_model_name": "DeviceModelName",
    "icc_profile_name": "ICCProfileName",
    "color_space": "ColorSpace",
    "color_primaries": "ColorPrimaries",
    "video_frame_rate": "VideoFrameRate",
    "avg_frame_rate": "AvgFrameRate",
    "duration": "Duration",
    "exif_image_width": "ExifImageWidth",
    "image_width": "ImageWidth",
    "image_height": "ImageHeight",
    "gamma_curve": "GammaCurve",
    "video_bitrate": "VideoBitrate",
    "gps_latitude": "GPSLatitude",
    "gps_longitude": "GPSLongitude",
}

_OPEN: dict[tuple, Catalog] = {}


def open_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """One Catalog per application and state of the data directory. Times are read as UTC throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _OPEN:
        _OPEN[key] = Catalog(spark, sf_dir)
    return _OPEN[key]
