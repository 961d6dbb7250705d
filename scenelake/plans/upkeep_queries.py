"""State logs, moved files, duplicate groups and keyframes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators import changes as ch
from scenelake.operators import files
from scenelake.operators import state_log as sl
from scenelake.operators.keyframes import keyframes as representative_frames
from scenelake.plans.registry import query
from scenelake.plans.scene_queries import _DIFF
from scenelake.plans.tables import AS_OF, Catalog
from scenelake.session import cut_lineage

_EXPIRED = f"coalesce(status='processing' and lease_epoch is not null and lease_epoch<{AS_OF}, false)"


@query("snapshot_after_log", """select id, library_id, rel_path, case when status='poisoned' then 'pending' else status end as status, worker_id, lease_epoch,
  case when status='poisoned' then 0 else retry_count end as retry_count, case when status<>'poisoned' then error_message end as error_message, metadata_status from stuck""", {
    "reclaimed": f"""select * replace (case when x and retry_count>5 then 'poisoned' when x then 'pending' else status end as status,
  case when not x then worker_id end as worker_id, case when not x then lease_epoch end as lease_epoch,
  case when x and retry_count>5 then retry_count+1 else retry_count end as retry_count,
  case when x and retry_count>5 then 'lease ran out too often' else error_message end as error_message) from (select *, {_EXPIRED} as x from asset) q""",
    "stuck": f"""select * replace (case when mtime<{AS_OF}-6000000.0 and metadata_status='sharpness_processing' then 'exif_done'
  when mtime<{AS_OF}-6000000.0 and metadata_status='exif_processing' then null else metadata_status end as metadata_status) from reclaimed"""})
def snapshot_after_log(c: Catalog) -> DataFrame:
    """Three changes through the log, with a compaction after the second: what the rewriting forms give."""
    base, log = (f"{c.root}/state-{uuid.uuid4().hex}/{part}" for part in ("base", "log"))
    sl.write_base(c.asset, base, span=500)

    def logged(change, version: int) -> None:
        sl.append(sl.read_base(c.spark, base), sl.read_log(c.spark, log), change, log, version, reads=("library_id", "mtime"))

    logged(lambda rows: ch.reclaim_leases(rows, AS_OF), 1)
    logged(lambda rows: ch.reset_stuck_metadata(rows, 6_000_000, AS_OF), 2)
    sl.compact(c.spark, base, sl.read_log(c.spark, log), span=500)
    logged(ch.reset_poisoned, 3)
    now = sl.snapshot(sl.read_base(c.spark, base), sl.read_log(c.spark, log))
    return now.select(
        "id", "library_id", "rel_path", "status", "worker_id", F.unix_seconds("lease_expires_at").alias("lease_epoch"),
        "retry_count", "error_message", "metadata_status",
    )


# Size and type stand for the content, so digests repeat.
_KNOWN = "select id as asset_id, library_id, rel_path, md5(type||size) as digest from asset"
_FOUND = "select library_id, rel_path, md5(type||size) as digest from source_file"


def _digest() -> Column:
    return F.md5(F.concat("type", F.col("size").cast("string")))


def _known(c: Catalog) -> DataFrame:
    return c.asset.select(F.col("id").alias("asset_id"), "library_id", "rel_path", _digest().alias("digest"))


@query("moved_assets", """select 'moved' as change, digest, library_id=old_library_id as same_library, count(*)::bigint as n from moved group by all
union all select case when digest in (select digest from there) then 'copy' else 'new' end, digest, null, count(*) from fresh group by all
union all select 'missing', digest, null, count(*) from lost group by all""", {
    "known": _KNOWN, "found": _FOUND,
    "fresh0": "select * from found anti join known using (library_id, rel_path)",
    "gone0": "select * from known anti join found using (library_id, rel_path) where library_id not in (select slug from library where not is_active)",
    "near": """select digest, library_id, least(a, b) as n from (select digest, library_id, count(*) as a from gone0 group by all) x join (select digest, library_id, count(*) as b from fresh0 group by all) y using (digest, library_id)""",
    "rest": """select digest, least(a, b) as n from (select digest, count(*)-coalesce(any_value(n),0) as a from gone0 left join (select digest, sum(n) as n from near group by 1) s using (digest) group by 1) x
join (select digest, count(*)-coalesce(any_value(n),0) as b from fresh0 left join (select digest, sum(n) as n from near group by 1) s using (digest) group by 1) y using (digest)""",
    # Which file goes with which asset is open between equals; how many of a kind there are is not.
    "counts": "select digest, (select coalesce(sum(n),0) from near w where w.digest=d.digest) as n, (select coalesce(sum(n),0) from rest w where w.digest=d.digest) as m from (select digest from gone0 union select digest from fresh0) d",
    "moved": "select digest, 'a' as library_id, 'a' as old_library_id, unnest(range(0, n::bigint)) from counts where n>0 union all select digest, 'a', 'b', unnest(range(0, m::bigint)) from counts where m>0",
    "fresh": "select digest, unnest(range(0, (k-n-m)::bigint)) from (select digest, count(*) as k from fresh0 group by 1) q join counts using (digest) where k>n+m",
    "lost": "select digest, unnest(range(0, (k-n-m)::bigint)) from (select digest, count(*) as k from gone0 group by 1) q join counts using (digest) where k>n+m",
    "there": "select digest from found semi join known using (library_id, rel_path) union select digest from counts where n+m>0"})
def moved_assets(c: Catalog) -> DataFrame:
    """All files of a scan against all assets: how many of each content moved, were copied, are new or missing."""
    away = c.library.where(~F.col("is_active")).select(F.col("slug").alias("library_id"))
    found = c.source_file.select("library_id", "rel_path", _digest().alias("digest"))
    known = _known(c)
    rows = files.match_moves(known, found, away)
    digests = known.select("asset_id", F.col("digest").alias("of_asset"))
    named = rows.join(digests, "asset_id", "left").join(found, ["library_id", "rel_path"], "left")
    return named.groupBy(
        "change", F.coalesce("of_asset", "digest").alias("digest"),
        F.when(F.col("change") == "moved", F.col("library_id") == F.col("old_library_id")).alias("same_library"),
    ).agg(F.count("*").alias("n"))


@query("duplicate_groups", """select digest, coalesce(min(asset_id) filter (reachable), min(asset_id)) as representative, count(*)::bigint as copies, (count(*) filter (reachable))::bigint as reachable
from (select asset_id, digest, library_id not in (select slug from library where deleted_epoch is not null) as reachable from known k join asset a on a.id=k.asset_id where status not in ('failed','poisoned')) m group by 1""",
       {"known": "select id as asset_id, md5(type||size) as digest from asset"})
def duplicate_groups(c: Catalog) -> DataFrame:
    """Assets with the same content after two increments: all of them, then what has failed leaves its group."""
    trash = c.library.where("deleted_at is not null").select(F.col("slug").alias("library_id"), F.lit(False).alias("reachable"))
    all_ = c.asset.select("id", "library_id", "status", _digest().alias("digest")).join(trash, "library_id", "left").select(
        F.col("id").alias("asset_id"), "digest", F.coalesce("reachable", F.lit(True)).alias("reachable"), "status"
    )
    members = cut_lineage(all_.drop("status"))
    groups = cut_lineage(files.duplicate_groups(members))
    gone = all_.where(F.col("status").isin("failed", "poisoned")).select(
        "asset_id", F.lit(None).cast("string").alias("digest"), "reachable"
    )
    return files.regroup(groups, members, gone)[0]


@query("keyframes", """select asset_id, win as "window", frame_id, pts, frames, distance_sum from sums
qualify row_number() over (partition by asset_id, win order by distance_sum, pts, frame_id)=1""", {
    "durations": "select asset_id, max(pts) as duration_sec from frame group by asset_id",
    "placed": "select f.*, greatest(0, least(coalesce(floor(pts*8/nullif(duration_sec,0)),0), 7))::int as win from frame f join durations using (asset_id)",
    "sums": f"select a.asset_id, a.win, a.frame_id, a.pts, count(*)::bigint as frames, sum({_DIFF})::bigint as distance_sum from placed a join placed b on a.asset_id=b.asset_id and a.win=b.win group by all"})
def keyframes(c: Catalog) -> DataFrame:
    """The medoid of each eighth of every video."""
    return representative_frames(c.frame, n=8)


# Frames of a video stand for scans of a file that grows by blocks.
@query("stable_files", """select library_id, rel_path, size, mtime, since, last_seen, min(pts) filter (pts-since>=20) as stable_at
from (select *, max(case when changed then pts end) over w as since, max(pts) over w as last_seen, last_value(v) over (w order by pts rows between unbounded preceding and unbounded following) as size, 0.0::double as mtime
  from (select *, coalesce(lag(v) over (w order by pts)<>v, true) as changed from obs window w as (partition by rel_path)) q window w as (partition by rel_path)) r
where pts>=since group by all""", {
    "obs": "select 'videos' as library_id, asset_id::varchar as rel_path, pts, max(('0x'||substr(phash,2,7))::bigint) as v from frame group by all"})
def stable_files(c: Catalog) -> DataFrame:
    """Since when each file has been as it is, and when that had held for 20 seconds."""
    size = F.conv(F.substring("phash", 2, 7), 16, 10).cast("bigint").alias("size")
    scans = c.frame.select(
        F.lit("videos").alias("library_id"), F.col("asset_id").cast("string").alias("rel_path"), size,
        F.lit(0.0).alias("mtime"), F.col("pts").alias("seen_at"),
    )
    return files.stable_files(scans, 20.0)
