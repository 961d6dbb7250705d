"""SQL fragments shared by the DuckDB oracles."""

from __future__ import annotations

from scenelake.functions import stem
from scenelake.schemas import IMAGE_SUFFIXES, MEDIA_SUFFIXES, VIDEO_SUFFIXES


def _in(values) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


EXT = r"lower(regexp_extract(rel_path, '\.([^.]*)$', 1))"
IS_IMAGE = f"{EXT} in {_in(IMAGE_SUFFIXES)}"
IS_VIDEO = f"{EXT} in {_in(VIDEO_SUFFIXES)}"
IS_MEDIA = f"{EXT} in {_in(MEDIA_SUFFIXES)}"
LIVE = "library_id in (select slug from library where deleted_epoch is null)"
BASENAME = "regexp_extract(rel_path, '[^/]*$')"
READY = "status in ('proxied','analyzed_light','completed','extracting','analyzing')"
SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce({0},'')), '[^\p{{L}}\p{{N}}]+'), lambda x: x<>'')"

IMAGE_TEXT = "concat_ws(' ', description, tag1||' '||tag2, ocr_text)"
SCENE_TEXT = "concat_ws(' ', description, tag, ocr_text)"


def split(expr: str) -> str:
    return SPLIT.format(expr)


def searchable(image_text: str = IMAGE_TEXT, scene_text: str = SCENE_TEXT, tag: str | None = None) -> str:
    """Analysed live images and scenes of live videos with the text to search."""
    img_tag = f"and '{tag}' in (tag1, tag2)" if tag else ""
    vid_tag = f"and tag='{tag}'" if tag else ""
    return f"""
select 'i'||id as key, id as asset_id, null::bigint as scene_id, null::double as start_ts, null::double as end_ts,
  null::varchar as rep, library_id, {image_text} as txt
from image_asset where has_analysis and {LIVE} {img_tag}
union all
select 's'||s.id, s.asset_id, s.id, s.start_ts, s.end_ts, s.rep_frame_path, v.library_id, {scene_text.replace('description', 's.description').replace('ocr_text', 's.ocr_text')}
from scene s join video_asset v on v.id = s.asset_id
where s.has_analysis and v.{LIVE} {vid_tag}
"""


def word_ctes(terms: list[str]) -> dict[str, str]:
    """Cover-density rank of `sdoc` (key, txt) for documents that hold all terms."""
    last = ", ".join(
        f"max(case when w='{t}' then pos end) over (partition by key order by pos) as l{i}"
        for i, t in enumerate(terms)
    )
    lows = [f"l{i}" for i in range(len(terms))]
    start = f"least({','.join(lows)})" if len(lows) > 1 else lows[0]
    alive = " and ".join(f"{x} is not null" for x in lows)
    return {
        "toks": f"select key, unnest(ws) as w, generate_subscripts(ws,1) as pos from (select key, {split('txt')} as ws from sdoc) q",
        "hits": f"select key, w, pos, row_number() over (partition by key order by pos) as n from toks where w in {_in(terms)}",
        "lasts": f"select key, pos, n, {last} from hits",
        "starts": f"select key, pos, n, {start} as begin_pos from lasts where {alive}",
        "covers": "select key, begin_pos, min(pos) as end_pos, min(n) as end_n from starts group by 1,2",
        "ranks": """select c.key, sum(0.1/(1+(end_pos-begin_pos)-(end_n-h.n))) as rank
                    from covers c join hits h on h.key=c.key and h.pos=c.begin_pos group by 1""",
    }


def hit_ctes(terms: list[str] | None, sdoc: str) -> dict[str, str]:
    """CTEs up to `final`: hits with their rank; without terms every searchable row ranks 1."""
    out = {"sdoc": sdoc}
    out.update(word_ctes(terms) if terms else {"ranks": "select key, 1.0::double as rank from sdoc"})
    out["scored"] = "select d.*, r.rank from sdoc d join ranks r using (key)"
    out["combined"] = """
select asset_id, null::double as best_scene_ts, 1.0::double as match_ratio, rank as base_rank, null::varchar as best_rep_frame_path
from scored where scene_id is null
union all
select asset_id, first(start_ts order by rank desc, start_ts, scene_id), sum(end_ts-start_ts)/nullif(max(end_ts),0),
  max(rank), first(rep order by rank desc, start_ts, scene_id)
from scored where scene_id is not null group by asset_id"""
    out["final"] = "select *, base_rank*(1+2*coalesce(match_ratio,0)) as final_rank from combined"
    return out


HIT_COLUMNS = """asset_id, best_scene_ts, round(match_ratio,6) as match_ratio, round(final_rank,6) as final_rank,
  best_rep_frame_path"""

# Normalised metadata from the flat `exif` columns.
_LOCAL = """coalesce(try_strptime(date_time_original,'%Y:%m:%d %H:%M:%S'), try_strptime(create_date,'%Y:%m:%d %H:%M:%S'))"""
_OFFSET = r"""case when regexp_matches(trim(offset_time_original),'^[+-]*\d+:\d+$') then
  (cast(regexp_extract(offset_time_original,'(\d+):',1) as bigint)*60+cast(regexp_extract(offset_time_original,':(\d+)',1) as bigint))
  * case when trim(offset_time_original) like '+%' then 1 else -1 end end"""
CAPTURE_TS = f"case when {_LOCAL} is not null then epoch({_LOCAL})-coalesce({_OFFSET},0)*60.0 else mtime end::double"
CAPTURE_SOURCE = f"case when {_LOCAL} is null then 'asset_mtime' when {_OFFSET} is not null then 'exif' else 'exif_naive' end"
MAKE = "nullif(trim(make),'')"
MODEL = "coalesce(nullif(trim(model),''), nullif(trim(camera_model_name),''), nullif(trim(device_model_name),''))"
COLOR = """case when lower(icc_profile_name) like '%p3%' then 'DisplayP3'
  when try_cast(color_space as int)=1 then 'sRGB' when try_cast(color_space as int)=2 then 'AdobeRGB'
  when upper(color_primaries) like '%BT.709%' or upper(color_primaries) like '%BT709%' then 'Rec709'
  when upper(color_primaries) like '%BT.2020%' or upper(color_primaries) like '%BT2020%' then 'Rec2020' else 'Unknown' end"""


def _rate(col: str) -> str:
    num, den = (f"try_cast(split_part({col},'/',{i}) as double)" for i in (1, 2))
    return f"(case when {col} like '%/%' then case when {den}>0 then {num}/{den} end else try_cast(trim({col}) as double) end)"


RATE = f"case when type='video' then coalesce({_rate('video_frame_rate')},{_rate('avg_frame_rate')}) end"
DURATION = """case when type<>'video' then null when duration like '%:%:%' then
    try_cast(split_part(duration,':',1) as double)*3600+try_cast(split_part(duration,':',2) as double)*60+try_cast(split_part(duration,':',3) as double)
  when duration like '%:%' then try_cast(split_part(duration,':',1) as double)*60+try_cast(split_part(duration,':',2) as double)
  else try_cast(duration as double) end"""


def _whole(col: str) -> str:
    return f"cast(trunc(try_cast(trim({col}) as double)) as bigint)"


WIDTH = f"coalesce({_whole('exif_image_width')},{_whole('image_width')})"
HEIGHT = _whole("image_height")
_BITS = f"try_cast(trim(video_bitrate) as double)/nullif({WIDTH}*{HEIGHT}*({RATE}),0)"
HINT = f"""case when type='image' then 'original' when lower(gamma_curve) like '%s-log%' then 'original'
  when nullif(try_cast(trim(video_bitrate) as double),0) is null then 'unknown'
  when {_BITS}>=0.08 then 'original' when {_BITS}<=0.03 then 'proxy' else 'unknown' end"""
_LAT, _LON = "try_cast(gps_latitude as double)", "try_cast(gps_longitude as double)"
LAT = f"case when {_LAT} is not null and {_LON} is not null then {_LAT} end"
LON = f"case when {_LAT} is not null and {_LON} is not null then {_LON} end"

GEO_CTES = {
    "pts": f"select id, {LAT} as lat, {LON} as lon from exif",
    "dist": """select p.id, g.place_id, g.country, g.region, g.city,
  2*asin(sqrt(least(1.0, pow(sin(radians(g.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(g.lat))*pow(sin(radians(g.lon-p.lon)/2),2)))) as angle
  from pts p, gazetteer g where p.lat is not null""",
    "nearest": "select * from dist qualify row_number() over (partition by id order by angle, place_id)=1",
}


# English stems by the Snowball rules, over (t): each step as regular expressions on the word.


def _table(values: dict[str, str], column: str) -> str:
    return "case " + column + " " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


def _ends(values) -> str:
    return "(" + "|".join(values) + ")$"


_REGION = "^.*?[aeiouy][^aeiouy]"
_SHORT = "'^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$'"


def stem_ctes(words: str) -> dict[str, str]:
    """`stems` (t, stem) of the words (t) that the SELECT `words` gives."""
    cut = lambda s: f"left(w, len(w)-len({s}))"
    return {
        "st0": f"select t, regexp_replace(regexp_replace(t,'^y','Y'),'([aeiouy])y','\\1Y','g') as w from ({words}) q",
        "st1": f"""select *, case when regexp_matches(w,'^({"|".join(stem.REGION_PREFIX)})') then len(regexp_extract(w,'^({"|".join(stem.REGION_PREFIX)})'))
  when regexp_matches(w,'{_REGION}') then len(regexp_extract(w,'{_REGION}')) else len(w) end as r1 from st0""",
        "st2": f"select *, case when regexp_matches(substr(w,r1+1),'{_REGION}') then r1+len(regexp_extract(substr(w,r1+1),'{_REGION}')) else len(w) end as r2 from st1",
        "st3": """select t, r1, r2, case when w like '%sses' then left(w,len(w)-2) when regexp_matches(w,'ie[ds]$') then left(w,len(w)-case when len(w)>4 then 2 else 1 end)
  when regexp_matches(w,'(us|ss)$') then w when w like '%s' and regexp_matches(left(w,len(w)-1),'[aeiouy].') then left(w,len(w)-1) else w end as w from st2""",
        "st4": f"select *, regexp_extract(w,'{_ends(('eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'))}') as s from st3",
        "st5": f"""select t, r1, r2, case when s='' then w when s like 'eed%' then case when len(w)-len(s)>=r1 then {cut('s')}||'ee' else w end
  when not regexp_matches({cut('s')},'[aeiouy]') then w when regexp_matches({cut('s')},'(at|bl|iz)$') then {cut('s')}||'e'
  when regexp_matches({cut('s')},'(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then left(w,len(w)-len(s)-1)
  when r1>=len(w)-len(s) and regexp_matches({cut('s')},{_SHORT}) then {cut('s')}||'e' else {cut('s')} end as w from st4""",
        "st6": "select t, r1, r2, case when len(w)>2 then regexp_replace(w,'([^aeiouy])[yY]$','\\1i') else w end as w from st5",
        "st7": f"select *, regexp_extract(w,'{_ends(stem.SECOND)}') as s from st6",
        "st8": f"""select t, r1, r2, case when s='' or len(w)-len(s)<r1 or (s='ogi' and {cut('s')} not like '%l') or (s='li' and not regexp_matches({cut('s')},'[{stem.BEFORE_LI}]$')) then w
  else {cut('s')}||{_table(stem.SECOND, 's')} end as w from st7""",
        "st9": f"select *, regexp_extract(w,'{_ends(stem.THIRD)}') as s from st8",
        "st10": f"select t, r1, r2, case when s='' or len(w)-len(s)<case when s='ative' then r2 else r1 end then w else {cut('s')}||{_table(stem.THIRD, 's')} end as w from st9",
        "st11": f"select *, regexp_extract(w,'{_ends(stem.FOURTH)}') as s from st10",
        "st12": f"select t, r1, r2, case when s='' or len(w)-len(s)<r2 or (s='ion' and not regexp_matches({cut('s')},'[st]$')) then w else {cut('s')} end as w from st11",
        "stems": f"""select s2.t, case when len(s2.t)<3 then s2.t when s2.t in {_in(stem.OWN_STEM)} then {_table(stem.OWN_STEM, 's2.t')} when s3.w in {_in(stem.FINISHED)} then s3.w
  else lower(case when s2.w like '%e' and (len(s2.w)-1>=s2.r2 or (len(s2.w)-1>=s2.r1 and not regexp_matches(left(s2.w,len(s2.w)-1),{_SHORT}))) then left(s2.w,len(s2.w)-1)
  when s2.w like '%ll' and len(s2.w)-1>=s2.r2 then left(s2.w,len(s2.w)-1) else s2.w end) end as stem from st12 s2 join st3 s3 using (t)""",
    }
