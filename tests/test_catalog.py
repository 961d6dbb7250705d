import datetime

import pytest
from pyspark.sql import functions as F

from scenelake import schemas as sc
from scenelake.functions import paths
from scenelake.operators import catalog as cat
from scenelake.operators import counts, lifecycle, maintenance, workers
from scenelake.sources.records import asset_summary

NOW = 1_700_000_000


def _ts(seconds):
    return datetime.datetime.fromtimestamp(NOW + seconds, datetime.timezone.utc).replace(tzinfo=None)


def table(spark, schema, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)


@pytest.fixture(scope="module")
def library(spark):
    return table(
        spark, sc.LIBRARY, {"slug": "lib1", "scan_status": "idle", "absolute_path": "/m/1", "is_active": True},
        {"slug": "lib2", "scan_status": "scanning", "name": "Two", "is_active": True},
        {"slug": "lib3", "scan_status": "full_scan_requested", "target_tagger_id": 7, "is_active": True},
        {"slug": "bin", "scan_status": "fast_scan_requested", "deleted_at": _ts(0), "is_active": True},
    )


@pytest.fixture(scope="module")
def asset(spark):
    rows = [(1, "lib1", "completed"), (2, "lib1", "completed"), (3, "lib2", "pending"), (4, "lib3", "completed"), (5, "lib3", "analyzing")]
    return table(spark, sc.ASSET, *[
        {"id": i, "library_id": lib, "status": s, "type": "image", "rel_path": f"{i}.jpg", "size": 1536 * i, "analysis_model_id": 7 if i == 4 else None}
        for i, lib, s in rows])


def test_stats_and_status(asset, library):
    assert tuple(counts.catalog_stats(asset, library).first()) == (5, 1, 2, True)
    rows = {r["slug"]: (r["name"], r["is_analyzing"]) for r in counts.library_status(asset, library).collect()}
    assert rows == {"lib1": ("lib1", False), "lib2": ("Two", True), "lib3": ("lib3", True)}
    assert counts.any_analyzing(asset, library, ["lib1"]).first()[0] is False
    assert counts.any_analyzing(asset, library).first()[0] is True
    assert counts.count_assets(asset, "lib1").first()[0] == 2
    assert counts.count_assets(asset, "lib1", "pending").first()[0] == 0


def test_lookups(asset, library, spark):
    assert cat.asset_by_id(asset, library, 3).first()["library_id"] == "lib2"
    assert cat.asset_by_path(asset, library, "lib1", "2.jpg").first()["id"] == 2
    assert [r["size_kb"] for r in asset_summary(asset).orderBy("id").collect()] == [2, 3, 4, 6, 8]
    scene = table(spark, sc.VIDEO_SCENES, {"id": 9, "asset_id": 1})
    assert cat.scene_by_id(scene, 9).count() == 1
    models = table(spark, sc.AIMODEL, {"id": 1, "name": "b", "version": "1"}, {"id": 2, "name": "a", "version": "2"})
    assert [r["id"] for r in cat.list_models(models).collect()] == [2, 1]


def test_reanalysis_is_null_safe(asset, library):
    ids = {r["id"] for r in cat.expecting_reanalysis(asset, library, default_model=1).collect()}
    assert ids == {1, 2, 5}


def test_paging(asset, library):
    page = cat.browse_page(asset, library, "lib1", limit=1, sort_by="added", order="asc").collect()
    assert [(r["id"], r["has_more"]) for r in page] == [(1, True)]
    last = cat.browse_page(asset, library, "lib1", limit=1, offset=1, sort_by="added", order="asc").collect()
    assert [(r["id"], r["has_more"]) for r in last] == [(2, False)]


def test_scan_requests(library):
    assert [r["slug"] for r in lifecycle.scannable(library).collect()] == ["lib3"]
    busy = lifecycle.set_scan_status(library, "lib3", "scanning")
    assert lifecycle.scannable(busy).count() == 0


def test_work_takes_over_expired_leases(spark, library):
    rows = table(
        spark, sc.ASSET, {"id": 1, "library_id": "lib1", "rel_path": "a.JPG", "status": "pending"},
        {"id": 2, "library_id": "lib1", "rel_path": "b.jpg", "status": "processing", "lease_expires_at": _ts(-1)},
        {"id": 3, "library_id": "lib1", "rel_path": "c.jpg", "status": "processing", "lease_expires_at": _ts(9)},
        {"id": 4, "library_id": "lib3", "rel_path": "d.jpg", "status": "pending"},
        {"id": 5, "library_id": "bin", "rel_path": "e.jpg", "status": "pending"},
        {"id": 6, "library_id": "lib1", "rel_path": "f.txt", "status": "pending"},
    )
    got = cat.eligible_work(rows, library, "pending", ["jpg"], NOW)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4]
    got = cat.eligible_work(rows, library, "pending", [".jpg"], NOW, target_model=7, default_model=1)
    assert [r["id"] for r in got.collect()] == [4]


def _workers(spark, *rows):
    return table(spark, sc.WORKER_STATUS, *[
        {"worker_id": w, "hostname": h, "state": s, "last_seen_at": _ts(age), "stats": stats} for w, h, s, age, stats in rows])


def test_peers_and_ghosts(spark, asset):
    stage = {"current_stage": "transcode"}
    ws = _workers(
        spark, ("self", "h", "idle", 0, None), ("peer", "h", "processing", -60, stage), ("off", "h", "offline", 0, stage),
        ("old", "h", "idle", -61, None), ("far", "g", "idle", 0, stage), ("ancient", "g", "idle", -90_000, None),
    )
    peers = {r["worker_id"]: r["active_peers"] for r in workers.active_peers(ws, NOW).collect()}
    assert peers["self"] == 1 and peers["old"] == 2 and peers["far"] == 0
    leased = table(spark, sc.ASSET, {"id": 1, "worker_id": "peer", "status": "processing", "lease_expires_at": _ts(5)},
                   {"id": 2, "worker_id": "far", "status": "processing", "lease_expires_at": _ts(-5)})
    assert [r["hostname"] for r in workers.active_transcodes(ws, leased, NOW).collect()] == ["h"]
    assert workers.count_stale_workers(ws, NOW).first()[0] == 1
    assert workers.prune_stale_workers(ws, NOW).count() == 5
    assert workers.remove_workers(ws, ws.where("state = 'offline'").select("worker_id")).count() == 5
    assert workers.list_workers(ws).collect()[-1]["worker_id"] == "ancient"
    assert workers.fleet(ws, "25").first()["version"] == "25"
    assert workers.fleet_health(ws, NOW).first()["detail"] == "4 workers active"
    assert workers.fleet_health(ws.where("worker_id = 'ancient'"), NOW).first()["detail"].endswith("90000s before")
    assert workers.fleet_health(ws.limit(0), NOW).first()["detail"] == "no worker is known"


def test_preview_counts_what_the_clean_up_takes(spark, asset, library):
    files = spark.createDataFrame(
        [("lib1/thumbnails/1/1.jpg", 0.0, 5), ("lib1/thumbnails/1/77.jpg", 0.0, 7), ("lib1/proxies/9/x.jpg", float(NOW), 7),
         ("bin/thumbnails/1/9.jpg", 0.0, 7), ("video_clips/lib1/4/clip_1.mp4", 0.0, 11), ("other/x", 0.0, 1)],
        sc.FILE_INVENTORY,
    )
    scene = table(spark, sc.VIDEO_SCENES)
    gone = maintenance.orphan_files(files, asset, scene, library, 60, NOW)
    assert sorted(r["path"] for r in gone.collect()) == ["lib1/thumbnails/1/77.jpg", "video_clips/lib1/4/clip_1.mp4"]
    assert tuple(maintenance.file_totals(gone).first()) == (2, 18)


def test_truncation(spark):
    scene = table(spark, sc.VIDEO_SCENES, *[{"id": i, "asset_id": i, "end_ts": e} for i, e in ((1, 97.9), (2, 98.0), (3, 9.9), (4, 5.0))])
    durations = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 10.0), (4, None), (5, 50.0)], "asset_id bigint, duration_sec double")
    assert sorted(r["asset_id"] for r in maintenance.truncated_indexes(scene, durations).collect()) == [1]


def test_schema_helpers(spark):
    rows = spark.createDataFrame([(1, "x")], "id int, library_id string")
    full = sc.conform(rows, sc.ASSET)
    assert full.schema["id"].dataType == sc.ASSET["id"].dataType and full.columns == sc.ASSET.names
    path = spark.range(1).select(paths.scene_frame_path(F.lit("a"), F.lit(5), F.lit(1.0), F.lit(2.5))).first()[0]
    assert path == "video_scenes/a/5/1.000_2.500.jpg"
    for allowed, column in ((sc.SCAN_STATUSES, "scan_status"), (sc.ASSET_TYPES, "type"), (sc.ASSET_STATUSES, "status"),
                            (sc.WORKER_STATES, "state"), (sc.KEEP_REASONS, "keep_reason")):
        df = spark.createDataFrame([(allowed[0],), ("bad",)], f"{column} string")
        assert sc.invalid_rows(df, column, allowed).count() == 1
