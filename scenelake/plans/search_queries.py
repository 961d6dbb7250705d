"""Text search, tag search, index search and similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.text import Clause, parse_query
from scenelake.operators import ranking as rk
from scenelake.operators import search as se
from scenelake.operators.find import find
from scenelake.plans import oracle_parts as o
from scenelake.plans.registry import query
from scenelake.plans.tables import AS_OF, Catalog
from scenelake.sources import search_docs as sd
from scenelake.sources import text_index as ti
from scenelake.streaming.sync import sync_batch

WORDS = ["attion", "eriner"]
TAG = "en"
TEXT = " ".join(WORDS)


def _search(c: Catalog, **how) -> DataFrame:
    return se.search_assets(c.asset, c.scene, c.library, se.SearchRequest(**how), c.text_index)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select(
        "asset_id", "best_scene_ts", F.round("match_ratio", 6).alias("match_ratio"),
        F.round("final_rank", 6).alias("final_rank"), "best_rep_frame_path",
    )


def _top(limit: int, where: str = "true") -> str:
    return f"select {o.HIT_COLUMNS} from (select * from final where {where} order by final_rank desc, asset_id limit {limit}) q"


@query("fts_search", _top(50), o.hit_ctes(WORDS, o.searchable()))
def fts_search(c: Catalog) -> DataFrame:
    """Images and videos holding both words, best first."""
    return _shown(_search(c, query=TEXT))


@query("fts_search_all", f"select {o.HIT_COLUMNS} from final", o.hit_ctes(["thing"], o.searchable()))
def fts_search_all(c: Catalog) -> DataFrame:
    """Every hit of a single word, before the cut."""
    return _shown(se.all_hits(c.asset, c.scene, c.library, se.SearchRequest(query="thing"), c.text_index))


@query("fts_search_tag", _top(50), o.hit_ctes(["attion"], o.searchable(tag="en")))
def fts_search_tag(c: Catalog) -> DataFrame:
    return _shown(_search(c, query="attion", tag="en"))


@query("ocr_search", _top(30), o.hit_ctes(["attion"], o.searchable("coalesce(ocr_text,'')", "coalesce(ocr_text,'')")))
def ocr_search(c: Catalog) -> DataFrame:
    return _shown(_search(c, ocr_query="attion", limit=30))


@query("tag_search", f"select {o.HIT_COLUMNS} from (select * from final order by final_rank desc, asset_id limit 500) q",
       o.hit_ctes(None, o.searchable(tag="assistant")))
def tag_search(c: Catalog) -> DataFrame:
    """Assets carrying a tag; for videos, the share of time it covers counts."""
    req = se.SearchRequest(tag="assistant", limit=500)
    return _shown(se.search_assets(c.asset, c.scene, c.library, req, c.tag_index))


@query("search_by_library", f"select {o.HIT_COLUMNS} from (select final.* from final join asset on asset.id=asset_id where library_id in ('src1','src3','src6') and type='image' order by final_rank desc, asset_id limit 50) q",
       o.hit_ctes(["attion"], o.searchable()))
def search_by_library(c: Catalog) -> DataFrame:
    """Images of three libraries, one of them in the trash."""
    return _shown(_search(c, query="attion", libraries=("src1", "src3", "src6"), types=("image",)))



@query(
    "fts_operators",
    "select key, asset_id from sdoc where (n like '% attion eriner %' and n not like '% thing %') or n like '% thanea %'",
    {"sdoc0": o.searchable(), "sdoc": r"select *, ' '||regexp_replace(regexp_replace(lower(txt),'[^\p{L}\p{N}]+',' ','g'),'^ | $','','g')||' ' as n from sdoc0"},
)
def fts_operators(c: Catalog) -> DataFrame:
    """Phrase, exclusion and alternative in one query: the documents that match."""
    req = se.SearchRequest(query='"attion eriner" -thing or thanea')
    found = se.found_at(c.text_index, parse_query(req.query))
    kinds = {"image": "image", "scene": "video"}
    owners = [
        se.in_scope(c.asset, c.library, req, kind).select(F.col("id").alias("asset_id"), F.lit(own).alias("kind"))
        for own, kind in kinds.items()
    ]
    live = found.join(owners[0].unionByName(owners[1]), ["asset_id", "kind"], "left_semi")
    return live.select(F.concat(F.substring("kind", 1, 1), F.col("id").cast("string")).alias("key"), "asset_id")


@query("fts_rank", "select key, round(rank,6) as rank from ranks",
       {"sdoc": "select 'd'||id as key, description as txt from image_asset where description is not null", **o.word_ctes(["ing", "the", "thing"])})
def fts_rank(c: Catalog) -> DataFrame:
    """Cover-density rank of every description for three words, two of them frequent."""
    found = se.found_at(c.text_index, [Clause(("ing", "the", "thing"))], "description").where("kind = 'image'")
    return found.select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("key"), F.round("rank", 6).alias("rank"))


@query(
    "search_confidence",
    """select asset_id, round_even(100*final_rank/max(final_rank) over (),0)::bigint as confidence,
  case when round_even(100*final_rank/max(final_rank) over (),0)>80 then 'high' when round_even(100*final_rank/max(final_rank) over (),0)>50 then 'medium' else 'low' end as band
from (select * from final order by final_rank desc, asset_id limit 50) q""",
    o.hit_ctes(["attion"], o.searchable()),
)
def search_confidence(c: Catalog) -> DataFrame:
    return se.with_confidence(_search(c, query="attion")).select("asset_id", "confidence", "band")


@query(
    "result_projection",
    f"""select asset_id, type, case when status not in ('pending','processing','failed','poisoned') then '/media/'||library_id||'/thumbnails/'||(asset_id%1000)||'/'||asset_id||'.jpg' end as thumbnail_url,
  case when type='video' and best_rep_frame_path<>'' then '/media/'||best_rep_frame_path end as preview_url, '/media/'||video_preview_path as video_preview_url,
  status, error_message, round(final_rank,6) as final_rank, round(match_ratio*100,1) as match_ratio,
  printf('%02d:%02d', cast(floor(best_scene_ts) as bigint)//60, cast(floor(best_scene_ts) as bigint)%60) as best_scene_ts, best_scene_ts as best_scene_ts_seconds,
  library_id as library_slug, coalesce(l.name, l.slug) as library_name, {o.BASENAME} as filename
from (select * from final order by final_rank desc, asset_id limit 50) q join asset a on a.id=q.asset_id join library l on l.slug=a.library_id""",
    o.hit_ctes(["attion"], o.searchable()),
)
def result_projection(c: Catalog) -> DataFrame:
    """Hits as a user sees them."""
    rows = se.result_rows(_search(c, query="attion"), c.asset, c.library)
    return rows.withColumn("final_rank", F.round("final_rank", 6))


# Search documents and their indexes -----------------------------------------------------------


_DOCS = {
    "doc0": """select 'asset_'||id as id, 0::bigint as scene_id, id as asset_id, library_id as library_slug, concat_ws(' ', description, ocr_text, tag1||' '||tag2) as txt
from image_asset where status='completed'
union all select 'scene_'||s.id, s.id, s.asset_id, v.library_id, concat_ws(' ', s.description, s.ocr_text, s.tag)
from scene s join video_asset v on v.id=s.asset_id where v.status='completed'""",
    # Libraries in the trash are never searched.
    "doc": """select * from (select d.*, active_index_name as index_name from doc0 d join policy p using (library_slug) where active_index_name is not null
union all select d.*, shadow_index_name from doc0 d join policy p using (library_slug) where shadow_index_name is not null) i
where library_slug in (select slug from library where deleted_epoch is null)""",
}
_ACTIVE = "index_name in (select active_index_name from policy where active_index_name is not null {0})"


def _bm25(scope: str, weights: str, needed: int | None) -> dict[str, str]:
    """Scores of the documents in `scope` for the (term, weight) rows of `weights`."""
    every = f"where (select count(*) from tf x where x.id=t.id)={needed}" if needed else ""
    return {
        "bdoc": scope,
        "wts": weights,
        "words": f"select id, {o.split('txt')} as ws from bdoc",
        "coll": "select count(*) as n, avg(len(ws)) as mean from words",
        "tf": "select id, w as term, count(*) as tf from (select id, unnest(ws) as w from words) q where w in (select term from wts) group by 1,2",
        "df": "select term, count(*) as df from tf group by 1",
        "bm25": f"""select t.id, sum(wts.weight*ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len(ws)/mean))) as score
from tf t join df using (term) join wts using (term) join words w on w.id=t.id, coll {every} group by 1""",
    }


def _flat_weights(words: list[str]) -> str:
    return " union all ".join(f"select '{w}' as term, 1 as weight" for w in words)


def _scored(docs: DataFrame) -> DataFrame:
    return docs.select("id", "asset_id", "scene_id", "library_slug", F.round("score", 6).alias("score"))


def _scored_sql(limit: int) -> str:
    return f"""select d.id, d.asset_id, d.scene_id, d.library_slug, round(score,6) as score
from (select * from bm25 order by score desc, id limit {limit}) q join bdoc d on d.id=q.id"""


@query("search_docs", f"""select 'asset_'||a.id as id, 0::bigint as scene_id, a.id as asset_id, a.library_id as library_slug, {o.CAPTURE_TS.replace('mtime','a.mtime')} as capture_ts, n.country, n.region, n.city,
  {o.MAKE} as camera_make, {o.MODEL} as camera_model, {o.COLOR} as color_space, 'original' as generation_hint, {o.WIDTH} as resolution_w, {o.HEIGHT} as resolution_h,
  null::double as duration_sec, null::double as frame_rate, null::boolean as has_face, null::double as sharpness_score, null::double as scene_start_ts, null::double as scene_end_ts,
  description, ocr_text, coalesce(tag1||'|'||tag2,'') as tags, preview_path as rep_frame_path, null::varchar as head_clip_path, preview_path is not null as preview_ready, false as playable,
  true as searchable, false as offline_ready, {AS_OF}::bigint as indexed_at
from image_asset a join exif e on e.id=a.id left join nearest n on n.id=a.id where status='completed'
union all
select 'scene_'||s.id, s.id, a.id, a.library_id, {o.CAPTURE_TS.replace('mtime','a.mtime')}, n.country, n.region, n.city, {o.MAKE}, {o.MODEL}, {o.COLOR}, {o.HINT.replace("type=", "e.type=").replace("type<>", "e.type<>")}, {o.WIDTH}, {o.HEIGHT},
  {o.DURATION.replace("type<>", "e.type<>")}, round({o.RATE.replace("type=", "e.type=")},6), null, null, s.start_ts, s.end_ts, s.description, s.ocr_text, coalesce(s.tag,''), s.rep_frame_path, a.video_preview_path,
  a.video_preview_path is not null, a.video_preview_path is not null, true, false, {AS_OF}
from scene s join video_asset a on a.id=s.asset_id join exif e on e.id=a.id left join nearest n on n.id=a.id where a.status='completed'""", o.GEO_CTES)
def search_docs(c: Catalog) -> DataFrame:
    """All documents with every field."""
    docs = sd.build_documents(
        c.asset.join(c.metadata.withColumnRenamed("m", "media_metadata"), "id"), c.scene, AS_OF
    )
    return docs.withColumn("tags", F.array_join("tags", "|")).withColumn("frame_rate", F.round("frame_rate", 6))


@query("bm25_search", _scored_sql(50), {**_DOCS, **_bm25(
    f"select * from doc where {_ACTIVE.format('')} and scene_id<1", _flat_weights(WORDS), len(WORDS))})
def bm25_search(c: Catalog) -> DataFrame:
    """Image documents of all active indexes that hold both words."""
    docs, postings = (rk.active_documents(t, c.policy, c.library) for t in (c.documents, c.postings))
    return _scored(rk.bm25_search(docs, TEXT, types=["image"], postings=postings))


_THREE = "('src1','src3','src4')"


@query("routed_search", _scored_sql(40), {**_DOCS, **_bm25(
    f"select * from doc where {_ACTIVE.format('and library_slug in ' + _THREE)} and library_slug in {_THREE}", _flat_weights(["the"]), 1)})
def routed_search(c: Catalog) -> DataFrame:
    """Documents of three libraries through the indexes their policies name."""
    return _scored(rk.routed_search(
        c.documents, c.policy, c.library, "the", ["src1", "src3", "src4"], limit=40, postings=c.postings
    ))


@query("shadow_search", _scored_sql(50), {**_DOCS, **_bm25("select * from doc where index_name='media_scenes_src1_200'", _flat_weights(["the"]), 1)})
def shadow_search(c: Catalog) -> DataFrame:
    """One index by name."""
    return _scored(rk.shadow_search(c.documents, "media_scenes_src1_200", c.library, "the", postings=c.postings))


_SOURCE = 2


def _similar_weights() -> str:
    return f"""select term, count(*) as weight from (select unnest({o.split("q")}) as term from (
  select array_to_string(list_concat(list_filter(ws, lambda x, i: x<>'' and list_position(ws,x)=i), [lower(tag1),lower(tag2)], [lower(tag1),lower(tag2)]),' ') as q
  from (select string_split(trim(regexp_replace(regexp_replace(description, '[-"()\\[\\]{{}}:^~*?\\\\/+!&|]',' ','g'),'\\s+',' ','g')),' ') as ws, tag1, tag2 from image_asset where id={_SOURCE}) a) b) c group by 1"""


def _cut_sql(tried: list[float], max_results: int) -> str:
    counts = ", ".join(f"count(*) filter (score>={t!r}) as n{i}" for i, t in enumerate(tried))
    pick = " ".join(f"when n{i}>=3 then {t!r}" for i, t in enumerate(tried))
    return f"""select d.id, d.asset_id, round(score,6) as score, threshold_used::double as threshold_used from
(select * from bm25 order by score desc, id limit {max_results}) q join bdoc d on d.id=q.id,
(select case {pick} else {tried[-1]!r} end as threshold_used from (select {counts} from (select * from bm25 order by score desc, id limit {max_results}) x) y) z
where score>=threshold_used"""


def _similar_shown(docs: DataFrame) -> DataFrame:
    return docs.select("id", "asset_id", F.round("score", 6).alias("score"), "threshold_used")


@query("similar_assets", _cut_sql(rk.thresholds(rk.MIN_SCORE, rk.FLOOR, rk.STEP), 20), {**_DOCS, **_bm25(
    f"select * from doc where {_ACTIVE.format('')} and asset_id<>{_SOURCE}", _similar_weights(), None)})
def similar_assets(c: Catalog) -> DataFrame:
    """The documents most like one image."""
    return _similar_shown(rk.similar_assets(
        c.documents, c.asset, c.policy, c.library, _SOURCE, postings=c.postings
    ))


_SCOPED = {**_DOCS, "meta": f"select id as asset_id, {o.CAPTURE_TS} as capture_ts, {o.MAKE} as camera_make, {o.MODEL} as camera_model from exif"}


@query("similarity_scope", _cut_sql(rk.thresholds(70.0, 20.0, 0.7), 100), {**_SCOPED, **_bm25(
    f"""select d.* from doc d join meta m using (asset_id) where {_ACTIVE.format('')} and asset_id<>{_SOURCE} and scene_id<1 and capture_ts>=1600000000 and capture_ts<=1700300000
  and (camera_make='Canon' or (camera_make='NIKON' and camera_model='R5'))""", _similar_weights(), None)})
def similarity_scope(c: Catalog) -> DataFrame:
    """Similar images taken in a period with one of two cameras, under a descending threshold."""
    scope = rk.SimilarityScope(
        asset_types=("image",), from_ts=1_600_000_000, to_ts=1_700_300_000,
        cameras=(rk.Camera("Canon"), rk.Camera(" NIKON ", "R5")),
    )
    found = rk.similar_assets(
        c.documents, c.asset, c.policy, c.library, _SOURCE, scope, c.postings, max_results=100, min_score=70.0,
        floor=20.0, step=0.7,
    )
    return _similar_shown(found)


@query("similarity_faces", _cut_sql(rk.thresholds(30.0, 1.0, 0.5), 60), {**_SCOPED, **_bm25(
    f"select d.* from doc d where {_ACTIVE.format('')} and library_slug='src1' and asset_id<>{_SOURCE} and asset_id%2=0 and (asset_id%100)/100.0>=0.3", _similar_weights(), None)})
def similarity_faces(c: Catalog) -> DataFrame:
    """Similar assets of one library that show a face and are sharp."""
    scope = rk.SimilarityScope(library="src1", has_face=True, min_sharpness=0.3)
    return _similar_shown(rk.similar_assets(
        c.documents, c.asset, c.policy, c.library, _SOURCE, scope, c.postings, max_results=60, min_score=30.0, floor=1.0, step=0.5,
    ))


# Index upkeep: two increments, with one library that has no policy at first.

_NEW = "src3"
_SYNCED = {**_DOCS, "sdocs": f"""select d.*, coalesce(p.active_index_name, 'media_scenes_'||d.library_slug||'_{AS_OF}') as index_name
from doc0 d left join (select * from policy where library_slug<>'{_NEW}') p using (library_slug)
where library_slug in (select slug from library where deleted_epoch is null) and (p.library_slug is null or p.active_index_name is not null)"""}


def _synced(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, postings and policies after two increments."""
    root = f"{c.root}/synced-{uuid.uuid4().hex}"
    docs, postings = f"{root}/documents", f"{root}/postings"
    policy, cursor = c.policy.where(F.col("library_slug") != _NEW), None
    half = c.asset.agg(F.percentile_approx("id", F.lit(0.5))).first()[0]
    for asset in (c.asset.where(F.col("id") <= half), c.asset):
        done = sync_batch(asset, c.scene, c.library, policy, docs, postings, AS_OF, cursor)
        policy, cursor = done.policy, done.cursor
    return sd.read_documents(c.spark, docs), sd.read_documents(c.spark, postings), policy


@query("synced_documents", "select id, asset_id, scene_id, library_slug, index_name from sdocs", _SYNCED)
def synced_documents(c: Catalog) -> DataFrame:
    """Every document that two increments have written, with its index."""
    return _synced(c)[0].select("id", "asset_id", "scene_id", "library_slug", "index_name")


@query("search_after_sync", _scored_sql(50), {**_SYNCED, **_bm25(
    f"select * from sdocs where library_slug in ('src1','{_NEW}')", _flat_weights(["the"]), 1)})
def search_after_sync(c: Catalog) -> DataFrame:
    """What was synced is found through its postings, in the new library too."""
    docs, postings, policy = _synced(c)
    return _scored(rk.routed_search(docs, policy, c.library, "the", ["src1", _NEW], postings=postings))


@query("index_search_tag", _scored_sql(50), {**_DOCS, **_bm25(
    f"select d.* from doc d where {_ACTIVE.format('')} and id in (select 'asset_'||id from image_asset where tag1='{TAG}' or tag2='{TAG}' union all select 'scene_'||id from scene where tag='{TAG}')",
    _flat_weights(["the"]), 1)})
def index_search_tag(c: Catalog) -> DataFrame:
    """Documents of active indexes that carry a tag."""
    return _scored(rk.routed_search(c.documents, c.policy, c.library, "the", postings=c.postings, tag=TAG))


@query("index_search_ocr", _scored_sql(50), {**_DOCS, **_bm25(
    f"""select d.* from doc d where {_ACTIVE.format('')} and id in (
  select 'asset_'||id from image_asset where list_contains({o.split('ocr_text')}, 'attion') union all select 'scene_'||id from scene where list_contains({o.split('ocr_text')}, 'attion'))""",
    _flat_weights(["attion"]), 1)})
def index_search_ocr(c: Catalog) -> DataFrame:
    """Documents of active indexes whose OCR text holds the word."""
    return _scored(rk.routed_search(c.documents, c.policy, c.library, "attion", postings=c.postings, ocr=True))


# One entry point.

_SHOWN = f"""asset_id, a.type, case when a.status not in ('pending','processing','failed','poisoned') then '/media/'||library_id||'/thumbnails/'||(asset_id%1000)||'/'||asset_id||'.jpg' end as thumbnail_url,
  case when a.type='video' and best_rep_frame_path<>'' then '/media/'||best_rep_frame_path end as preview_url, '/media/'||video_preview_path as video_preview_url,
  a.status, error_message, round(final_rank,6) as final_rank, round(coalesce(match_ratio,0)*100,1) as match_ratio,
  printf('%02d:%02d', cast(floor(best_scene_ts) as bigint)//60, cast(floor(best_scene_ts) as bigint)%60) as best_scene_ts, best_scene_ts as best_scene_ts_seconds,
  library_id as library_slug, coalesce(l.name, l.slug) as library_name, {o.BASENAME} as filename"""


def _found(c: Catalog, policy: DataFrame, **how) -> DataFrame:
    rows = find(
        c.asset, c.scene, c.library, policy, lambda: c.documents, lambda: c.postings, se.SearchRequest(**how), c.text_index
    )
    return rows.withColumn("final_rank", F.round("final_rank", 6)).drop("incomplete")


_BY_INDEX = """select asset_id, first(start_ts order by score desc, scene_id) as best_scene_ts, null::double as match_ratio, max(score) as final_rank,
  first(rep order by score desc, scene_id) as best_rep_frame_path, 'index' as searched
from (select d.*, q.score, s.start_ts, coalesce(s.rep_frame_path, i.preview_path) as rep from bm25 q join bdoc d on d.id=q.id
  left join scene s on d.id like 'scene_%' and s.id=d.scene_id left join asset i on d.id like 'asset_%' and i.id=d.asset_id) e
group by asset_id order by final_rank desc, asset_id limit {0}"""
_SHOWN_FROM = "join asset a on a.id=h.asset_id join library l on l.slug=a.library_id"
_INDEXED = "(select library_slug from policy where active_index_name is not null)"


@query("search_by_index", f"select {_SHOWN}, searched from ({_BY_INDEX.format(30)}) h {_SHOWN_FROM}", {**_DOCS, **_bm25(
    f"select * from doc where {_ACTIVE.format('and library_slug in ' + _THREE)} and library_slug in {_THREE}", _flat_weights(["the"]), 1)})
def search_by_index(c: Catalog) -> DataFrame:
    """Three libraries, all with an index: the best document of each asset, before the cut."""
    return _found(c, c.policy, query="the", libraries=("src1", "src3", "src4"), limit=30)


@query("search", f"""select {_SHOWN}, searched from (
  select * replace (final_rank/max(final_rank) over (partition by searched) as final_rank) from (select * from ({_BY_INDEX.format(50)}) x union all
    select asset_id, best_scene_ts, match_ratio, final_rank, best_rep_frame_path, 'catalog' from (select final.* from final join asset on asset.id=asset_id where library_id not in {_INDEXED} order by final_rank desc, asset_id limit 50) y) z
  order by final_rank desc, asset_id limit 50) h {_SHOWN_FROM}""", {**_DOCS, **o.hit_ctes(WORDS, o.searchable()), **_bm25(
    f"select * from doc where {_ACTIVE.format('')}", _flat_weights(WORDS), len(WORDS))})
def search(c: Catalog) -> DataFrame:
    """Words over all libraries: by index where there is one, over the catalog elsewhere."""
    return _found(c, c.policy, query=TEXT)


@query("search_mixed_scope", f"""select {_SHOWN}, searched from (
  select * replace (final_rank/max(final_rank) over (partition by searched) as final_rank) from (select * from ({_BY_INDEX.format(40)}) x union all
    select asset_id, best_scene_ts, match_ratio, final_rank, best_rep_frame_path, 'catalog' from (select final.* from final join asset on asset.id=asset_id where library_id in ('src2','src4') order by final_rank desc, asset_id limit 40) y) z
  order by final_rank desc, asset_id limit 40) h {_SHOWN_FROM}""", {**_DOCS, **o.hit_ctes(["attion"], o.searchable()), **_bm25(
    "select * from doc where index_name in (select active_index_name from policy where library_slug in ('src1','src3')) and library_slug in ('src1','src3')", _flat_weights(["attion"]), 1)})
def search_mixed_scope(c: Catalog) -> DataFrame:
    """Four libraries, of which two have an index: none is left out."""
    policy = c.policy.where(F.col("library_slug").isin("src1", "src3"))
    return _found(c, policy, query="attion", libraries=("src1", "src2", "src3", "src4"), limit=40)


@query("search_deleted", f"""select {_SHOWN.replace('coalesce(l.name, l.slug)', 'coalesce(l.name, library_id)')}, 'catalog' as searched
from (select * from final order by final_rank desc, asset_id limit 60) h {_SHOWN_FROM.replace('join library', 'left join library')}""",
       o.hit_ctes(["attion"], o.searchable().replace(f"and {o.LIVE}", "").replace(f"and v.{o.LIVE}", "")))
def search_deleted(c: Catalog) -> DataFrame:
    """Over the catalog, libraries in the trash included."""
    return _found(c, c.policy.where("false"), query="attion", limit=60, include_deleted=True)


@query("search_fallback", f"select {_SHOWN}, 'catalog' as searched from (select * from final order by final_rank desc, asset_id limit 50) h {_SHOWN_FROM}",
       o.hit_ctes(["attion"], o.searchable()))
def search_fallback(c: Catalog) -> DataFrame:
    """The same without any index: over the catalog."""
    return _found(c, c.policy.where("false"), query="attion")


# Search by stems.

_STEMMED = ["attion", "erin"]


def _stemmed_ctes(terms: list[str], sdoc: str) -> dict[str, str]:
    plain = o.hit_ctes(terms, sdoc)
    head = {
        "sdoc": plain.pop("sdoc"), "raw": plain["toks"].replace("ws,1) as pos", "ws,1) as pos"),
        **o.stem_ctes("select distinct w as t from raw"), "toks": "select key, stem as w, pos from raw join stems on t=w",
    }
    return {**head, **{k: v for k, v in plain.items() if k != "toks"}}


@query("fts_stemmed", _top(50), _stemmed_ctes(_STEMMED, o.searchable()))
def fts_stemmed(c: Catalog) -> DataFrame:
    """Both words in any form: stems of the query against stems of the texts."""
    req = se.SearchRequest(query="attions erining")
    return _shown(se.search_assets(c.asset, c.scene, c.library, req, c.stemmed_index))


@query("word_stems", "select t as term, stem from stems", {
    "sdoc": o.searchable().replace(f"and {o.LIVE}", "").replace(f"and v.{o.LIVE}", ""),
    "raw": f"select unnest({o.split('txt')}) as w from sdoc", **o.stem_ctes("select distinct w as t from raw")})
def word_stems(c: Catalog) -> DataFrame:
    """The stem of every word of the catalog's texts."""
    return ti.word_stems(ti.different_words(c.asset, c.scene))


# Changes to an index that is never rewritten in place.

_CHANGED = "case status when 'failed' then 'DELETE' when 'poisoned' then 'DELETE' when 'processing' then 'UPSERT' end"
_LATER = "case status when 'extracting' then 'DELETE' when 'analyzing' then 'UPSERT' end"


def _outbox(asset: DataFrame, action: str) -> DataFrame:
    """Queued changes of all assets, each after an older one that says the opposite."""
    rows = asset.select("id", F.expr(action).alias("action")).where("action is not null")
    old = F.when(F.col("action") == "DELETE", "UPSERT").otherwise("DELETE")
    now = rows.select((F.col("id") * 2).alias("seq"), F.col("id").alias("asset_id"), "action")
    return now.unionByName(rows.select((F.col("id") * 2 - 1).alias("seq"), F.col("id").alias("asset_id"), old.alias("action")))


def _renewed(rows: DataFrame, holder: str, statuses: list[str]) -> DataFrame:
    """An analysis with another description."""
    of = F.col(holder)
    text = F.concat_ws(" ", of["description"], F.lit("renewed attion"))
    return rows.withColumn(holder, F.when(F.col("status").isin(statuses) & of.isNotNull(), of.withField("description", text)).otherwise(of))


def _after(c: Catalog, gone: list[str], changed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Assets and scenes as they are after changes."""
    asset = _renewed(c.asset.where(~F.col("status").isin(gone)), "visual_analysis", changed)
    scene = c.scene.join(c.asset.select(F.col("id").alias("asset_id"), "status"), "asset_id")
    scene = scene.withColumn("metadata", F.when(
        F.col("status").isin(changed) & F.col("metadata.analysis").isNotNull(),
        F.col("metadata").withField("analysis.description", F.concat_ws(" ", "metadata.analysis.description", F.lit("renewed attion"))),
    ).otherwise(F.col("metadata")))
    return asset, scene.where(~F.col("status").isin(gone)).drop("status")


_GONE, _NEWER = "('failed','poisoned','extracting')", "('processing','analyzing')"
_CHANGED_DOCS = {
    "sdoc": f"""select 'image'||id as key, concat_ws(' ', description, case when status in {_NEWER} then 'renewed attion' end, tag1||' '||tag2, ocr_text) as txt
from image_asset where has_analysis and status not in {_GONE}
union all select 'scene'||s.id, concat_ws(' ', s.description, case when v.status in {_NEWER} then 'renewed attion' end, s.tag, s.ocr_text)
from scene s join video_asset v on v.id=s.asset_id where s.has_analysis and v.status not in {_GONE}""",
    "toks": f"select key, unnest({o.split('txt')}) as w from sdoc",
}


@query("index_after_changes", "select key, w as word, round(count(*)*0.1::double,6) as rank from toks where w in ('attion','renewed') group by all", _CHANGED_DOCS)
def index_after_changes(c: Catalog) -> DataFrame:
    """Two batches of changes with a compaction between them: what two words then find."""
    path = f"{c.root}/changed-{uuid.uuid4().hex}"
    # The catalog's own index serves other queries: it stays as it is, and the changes to it are kept apart.
    ti.apply_changes(_outbox(c.asset, _CHANGED), *_after(c, ["failed", "poisoned"], ["processing"]), f"{path}-a", 1)
    ti.compact(c.spark, f"{path}-a", f"{path}-b", base=c.text_index)
    gone = ["failed", "poisoned", "extracting"]
    ti.apply_changes(_outbox(c.asset, _LATER), *_after(c, gone, ["processing", "analyzing"]), f"{path}-b", 2)
    index = ti.read_index(c.spark, f"{path}-b")
    found = [
        se.found_at(index, [Clause((w,))]).select(
            F.concat("kind", F.col("id").cast("string")).alias("key"), F.lit(w).alias("word"), F.round("rank", 6).alias("rank"))
        for w in ("attion", "renewed")
    ]
    return found[0].unionByName(found[1])
