"""Segmentation and analysis of video scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators import segmentation as seg
from scenelake.operators import vision
from scenelake.plans.registry import query
from scenelake.plans.tables import Catalog
from scenelake.session import cut_lineage

_SCENES = "asset_id, start_ts, end_ts, keep_reason, best_pts, sharpness_score"
_DIFF = "+".join(
    f"bit_count(xor(('0x'||substr(a.phash,{i},8))::bigint, ('0x'||substr(b.phash,{i},8))::bigint))::bigint"
    for i in range(1, 65, 8)
)
SEGMENT_CTES = {
    "f": "select *, row_number() over (partition by asset_id order by pts, frame_id) as rn from frame",
    "durations": "select asset_id, cast(max(pts)*0.9+asset_id%30 as double) as duration_sec from frame group by asset_id",
    "nxt": f"""select a.asset_id, a.rn, a.pts, min(b.rn) as n_rn, min_by(b.pts, b.rn) as n_pts,
  min_by(case when b.pts-a.pts>=30 then 'temporal' else 'phash' end, b.rn) as reason
from f a left join f b on a.asset_id=b.asset_id and b.rn>a.rn and (b.pts-a.pts>=30 or (b.pts-a.pts>=3 and ({_DIFF})>51))
group by 1,2,3""",
    "chain": """select asset_id, rn, pts, n_rn, n_pts, reason from nxt where rn=1
union all select n.asset_id, n.rn, n.pts, n.n_rn, n.n_pts, n.reason from chain c join nxt n on n.asset_id=c.asset_id and n.rn=c.n_rn""",
    "lasts": "select asset_id, max(pts) as last_pts, max_by(sharpness, rn) as last_sharpness from f group by 1",
    "cut": """select c.asset_id, c.rn, c.pts as start_ts, coalesce(c.n_pts, greatest(l.last_pts, d.duration_sec)) as end_ts,
  coalesce(c.reason,'forced') as keep_reason, first(f.pts order by f.sharpness desc, f.rn) as b_pts, max(f.sharpness) as b_sharp, l.last_pts, l.last_sharpness, c.n_rn
from chain c join lasts l using (asset_id) join durations d using (asset_id)
left join f on f.asset_id=c.asset_id and f.rn>=c.rn+2 and (c.n_rn is null or f.rn<c.n_rn)
group by c.asset_id, c.rn, c.pts, c.n_pts, c.reason, c.n_rn, l.last_pts, l.last_sharpness, d.duration_sec""",
}
SEGMENT_SQL = """select asset_id, start_ts, round(end_ts,6) as end_ts, keep_reason, coalesce(b_pts, last_pts) as best_pts, coalesce(b_sharp, last_sharpness) as sharpness_score
from cut where b_pts is not null or n_rn is null"""


def durations(c: Catalog) -> DataFrame:
    return c.frame.groupBy("asset_id").agg(F.max("pts").alias("m")).select(
        "asset_id", (F.col("m") * 0.9 + F.col("asset_id") % 30).cast("double").alias("duration_sec")
    )


def _shown(scenes: DataFrame) -> DataFrame:
    return scenes.select(*_SCENES.split(", ")).withColumn("end_ts", F.round("end_ts", 6))


@query("segment_scenes", SEGMENT_SQL, SEGMENT_CTES)
def segment_scenes(c: Catalog) -> DataFrame:
    """All frames of all videos cut into scenes."""
    return _shown(seg.closed_scenes(seg.segment_scenes(c.frame, durations(c))))


@query("segment_blocks", SEGMENT_SQL, SEGMENT_CTES)
def segment_blocks(c: Catalog) -> DataFrame:
    """The same with videos spread over many one-minute blocks."""
    return _shown(seg.closed_scenes(seg.segment_scenes(c.frame, durations(c), block_seconds=60.0)))


@query("segment_resume", SEGMENT_SQL, SEGMENT_CTES)
def segment_resume(c: Catalog) -> DataFrame:
    """Scenes of the first 100 seconds, then the rest resumed from the stored progress and state."""
    early = cut_lineage(seg.segment_scenes(c.frame.where(F.col("pts") < 100), final=False))
    closed = seg.closed_scenes(early)
    progress = closed.groupBy("asset_id").agg(F.max("end_ts").alias("max_end_ts"))
    late = seg.segment_scenes(c.frame, durations(c), seg.open_states(early), progress)
    return _shown(closed.unionByName(seg.closed_scenes(late)))


# Longest common subsequence by diagonals of its table: all cells of one follow from the two before. Cells beyond
# the ends of a text compare with nothing and so change nothing.
_ALIKE = {
    "before": "select id, asset_id, description as t, lag(description) over (partition by asset_id order by start_ts, id) as p from scene",
    "sets": r"""select *, list_distinct(list_filter(string_split_regex(p,'\s+'), lambda x: x<>'')) as wp, list_distinct(list_filter(string_split_regex(t,'\s+'), lambda x: x<>'')) as wt
from before where length(p)>0 and length(t)>0 and p<>t""",
    "parts": """select id, wp, wt, list_filter(wp, lambda x: list_contains(wt,x)) as both_, array_to_string(list_sort(list_filter(wp, lambda x: not list_contains(wt,x))),' ') as a,
  array_to_string(list_sort(list_filter(wt, lambda x: not list_contains(wp,x))),' ') as b, length(array_to_string(list_filter(wp, lambda x: list_contains(wt,x)),' ')) as base from sets""",
    "todo": "select id, string_split(a,'') as ca, string_split(b,'') as cb, length(a) as n, length(b) as m from parts where len(wp)>0 and len(wt)>0 and not (len(both_)>0 and (a='' or b=''))",
    "diag": """select id, ca, cb, n, m, 1 as d, [0,0] as p1, [0] as p2 from todo
union all select id, ca, cb, n, m, d+1, [0]||list_transform(range(1,d+1), lambda i: case when ca[i]=cb[d+1-i] then p2[i]+1 else greatest(p1[i],p1[i+1]) end)||[0], p1 from diag where d<n+m""",
    "alike": """select id, case when len(wp)=0 or len(wt)=0 then 0.0::double when len(both_)>0 and (a='' or b='') then 100.0::double
  else greatest(100.0*(1-(length(a)+length(b)-2*p1[n+1])::double/(2*(base+(base>0)::int)+length(a)+length(b))),
    case when base>0 then 100.0*(1-(1+length(a))::double/(2*base+1+length(a))) end, case when base>0 then 100.0*(1-(1+length(b))::double/(2*base+1+length(b))) end) end as s
from parts left join (select * from diag where d=n+m) using (id)""",
}


@query("semantic_duplicates", f"""select id, asset_id, round(sim,4) as similarity, coalesce(sim>{vision.SEMANTIC_DUPLICATE_RATIO},false) as semantic_duplicate
from (select b.id, asset_id, case when p=t and length(t)>0 then 100.0::double else s end as sim from before b left join alike using (id)) q""", _ALIKE)
def semantic_duplicates(c: Catalog) -> DataFrame:
    """Scenes with their likeness to the scene before."""
    rows = vision.semantic_duplicates(c.scene)
    return rows.select("id", "asset_id", F.round("similarity", 4).alias("similarity"), "semantic_duplicate")


@query("scenes_needing_ocr", "select id, asset_id from scene where description is not null and not ocr_done")
def scenes_needing_ocr(c: Catalog) -> DataFrame:
    return vision.scenes_needing_ocr(c.scene).select("id", "asset_id")


@query("vision_worklist", """select pass, s.id, s.asset_id, coalesce(a.analysis_model_id<>2,false) or coalesce(a.tags_model_id<>2,false) as model_mismatch,
  case when coalesce(a.analysis_model_id<>2,false) or coalesce(a.tags_model_id<>2,false) then 'light' else pass end as mode
from (select *, case when description is null then 'light' when not ocr_done then 'full' end as pass from scene) s join asset a on a.id=s.asset_id where pass is not null""")
def vision_worklist(c: Catalog) -> DataFrame:
    """Work of both passes with model 2."""
    def one(mode: str) -> DataFrame:
        rows = vision.vision_worklist(c.scene, c.asset, 2, mode)
        return rows.select(F.lit(mode).alias("pass"), "id", "asset_id", "model_mismatch", "mode")

    return one("light").unionByName(one("full"))


@query("completable_videos", "select asset_id from scene group by 1 having bool_and(description is not null and ocr_done)")
def completable_videos(c: Catalog) -> DataFrame:
    return vision.completable_videos(c.scene)


@query("write_scene_analysis", """select id, case when description is null then 'new '||id else description end as description,
  case when description is null then 'x' else tag end as first_tag, case when description is null then null when not ocr_done then 'read' else ocr_text end as ocr_text,
  true as ocr_done from scene""")
def write_scene_analysis(c: Catalog) -> DataFrame:
    """Both passes run over everything they have to do."""
    todo = F.when(F.col("description").isNull(), "light").when(vision.needs_ocr(), "full")
    results = c.scene.select("id", todo.alias("mode")).where(F.col("mode").isNotNull()).select(
        "id", "mode",
        F.when(F.col("mode") == "light", F.concat(F.lit("new "), F.col("id").cast("string"))).alias("description"),
        F.when(F.col("mode") == "light", F.array(F.lit("x"))).alias("tags"),
        F.when(F.col("mode") == "full", "read").alias("ocr_text"),
    )
    a = F.col("metadata.analysis")
    return vision.write_scene_analysis(c.scene, results).select(
        "id", "description", a["tags"][0].alias("first_tag"), a["ocr_text"].alias("ocr_text"),
        a["ocr_done"].alias("ocr_done"),
    )
