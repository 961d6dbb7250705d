import datetime

import pytest
from pyspark.sql import functions as F

from scenelake.operators import changes as ch
from scenelake.schemas import ASSET, SOURCE_INVENTORY

NOW = 1_700_000_000


def _ts(seconds):
    return datetime.datetime.fromtimestamp(NOW + seconds, datetime.timezone.utc).replace(tzinfo=None)


def assets(spark, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in ASSET.fields} for r in rows], ASSET)


def found(spark, *rows):
    return spark.createDataFrame(rows, SOURCE_INVENTORY)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def _asset(i, **more):
    base = dict(id=i, library_id="a", rel_path=f"{i}.jpg", type="image", mtime=1.0, size=1, status="completed",
                retry_count=0, tags_model_id=3, worker_id="w")
    return {**base, **more}


def test_scan_upsert(spark):
    old = assets(
        spark, _asset(1), _asset(2), _asset(3, rel_path="v.mp4", type="video", preview_path="p", video_preview_path="q"),
        _asset(4),
    )
    scan = found(
        spark, ("a", "1.jpg", "image", 1.0, 1), ("a", "2.jpg", "image", 2.0, 1), ("a", "v.mp4", "video", 1.0, 9),
        ("a", "new.png", "image", 5.0, 5), ("b", "new.png", "image", 5.0, 5),
    )
    rows = by_id(ch.scan_upsert(old, scan))
    assert rows[1]["status"] == "completed" and rows[1]["worker_id"] == "w"
    assert rows[2]["status"] == "pending" and rows[2]["tags_model_id"] is None and rows[2]["worker_id"] is None
    assert rows[3]["status"] == "pending" and rows[3]["preview_path"] is None and rows[3]["video_preview_path"] is None
    assert rows[4]["status"] == "completed"
    assert sorted(rows) == [1, 2, 3, 4, 5, 6] and rows[5]["status"] == rows[6]["status"] == "pending"
    assert [r["id"] for r in ch.changed_videos(old, scan).collect()] == [3]


def test_scan_upsert_twice_changes_nothing(spark):
    scan = found(spark, *[("a", f"{i}.jpg", "image", float(i), i) for i in range(50)])
    once = ch.scan_upsert(assets(spark), scan)
    assert sorted(map(str, ch.scan_upsert(once, scan).collect())) == sorted(map(str, once.collect()))
    ids = [r["id"] for r in once.collect()]
    assert sorted(ids) == list(range(1, 51))


def test_reclaim(spark):
    df = assets(
        spark, _asset(1, status="processing", retry_count=6, lease_expires_at=_ts(-3600)),
        _asset(2, status="processing", retry_count=5, lease_expires_at=_ts(-1)),
        _asset(3, status="processing", retry_count=9, lease_expires_at=_ts(60)),
        _asset(4, status="processing", retry_count=9),
    )
    rows = by_id(ch.reclaim_leases(df, NOW))
    assert (rows[1]["status"], rows[1]["retry_count"]) == ("poisoned", 7)
    assert rows[1]["error_message"] == "lease ran out too often"
    assert (rows[2]["status"], rows[2]["retry_count"], rows[2]["worker_id"]) == ("pending", 5, None)
    assert rows[3]["status"] == rows[4]["status"] == "processing"
    assert by_id(ch.reclaim_leases(df, NOW, slug="other"))[1]["status"] == "processing"


def test_status_counts_retries_and_checks_the_owner(spark):
    df = assets(spark, _asset(1, retry_count=2), _asset(2, retry_count=2), _asset(3, retry_count=2))
    updates = spark.createDataFrame(
        [(1, "failed", "x", "w"), (2, "proxied", None, "w"), (3, "failed", "x", "other")],
        "id bigint, status string, error_message string, owner string",
    )
    rows = by_id(ch.apply_status(df, updates, check_owner=True))
    assert [(rows[i]["status"], rows[i]["retry_count"], rows[i]["worker_id"]) for i in (1, 2, 3)] == [
        ("failed", 3, None), ("proxied", 0, None), ("completed", 2, "w")]
    assert by_id(ch.apply_status(df, updates.drop("owner")))[3]["status"] == "failed"


def test_sharpness_merges_only_while_measuring(spark):
    meta = {"camera_make": "Canon"}
    df = assets(
        spark, _asset(1, metadata_status="sharpness_processing", media_metadata=meta),
        _asset(2, metadata_status="exif_done", media_metadata=meta), _asset(3, metadata_status="sharpness_processing"),
    )
    new = spark.createDataFrame([(i, True, 2, 0.5) for i in (1, 2, 3)], "id bigint, has_face boolean, face_count bigint, sharpness_score double")
    rows = by_id(ch.merge_sharpness(df, new))
    assert rows[1]["media_metadata"]["camera_make"] == "Canon" and rows[1]["media_metadata"]["sharpness_score"] == 0.5
    assert rows[1]["metadata_status"] == "complete"
    assert rows[2]["media_metadata"]["has_face"] is None and rows[2]["metadata_status"] == "exif_done"
    assert rows[3]["media_metadata"]["face_count"] == 2


def test_metadata_states(spark):
    df = assets(
        spark, _asset(1, metadata_status="exif_processing"), _asset(2, metadata_status="sharpness_processing"),
        _asset(3, metadata_status="exif_processing", mtime=float(NOW)), _asset(4, metadata_status="complete"),
    )
    rows = by_id(ch.reset_stuck_metadata(df, 60, NOW))
    assert [rows[i]["metadata_status"] for i in (1, 2, 3, 4)] == [None, "exif_done", "exif_processing", "complete"]
    assert by_id(ch.reset_stuck_metadata(df, 0, NOW))[1]["metadata_status"] == "exif_processing"
    back = by_id(ch.return_to_exif_done(df, spark.createDataFrame([(1,), (2,)], "id bigint")))
    assert [back[i]["metadata_status"] for i in (1, 2)] == ["exif_processing", "exif_done"]


def test_write_exif_then_attributes(spark):
    df = assets(spark, _asset(1), _asset(2, video_preview_path="old"))
    raw = spark.createDataFrame([(1, {"Model": " R5 "})], "id bigint, raw_exif map<string,string>")
    rows = by_id(ch.write_exif(df, raw))
    assert rows[1]["media_metadata"]["camera_model"] == "R5" and rows[1]["metadata_status"] == "exif_done"
    assert rows[2]["raw_exif"] is None
    up = spark.createDataFrame([(2, None, 513000)], "id bigint, video_preview_path string, segmentation_version bigint")
    got = by_id(ch.apply_attributes(df, up))[2]
    assert got["video_preview_path"] is None and got["segmentation_version"] == 513000


@pytest.mark.parametrize("stage,kind,retries,expected", [
    ("image_analysis", "transient", 9, "proxied"), ("image_analysis", "other", 0, "poisoned"),
    ("video_analysis", "other", 5, "failed"), ("video_analysis", "other", 6, "poisoned"),
    ("video_proxy", "permanent", 0, "poisoned"), ("image_proxy", "transient", 0, "failed"),
])
def test_failures(spark, stage, kind, retries, expected):
    got = spark.range(1).select(
        ch.status_after_failure(F.lit(stage), F.lit(kind), F.lit("proxied"), F.lit(retries))
    ).first()[0]
    assert got == expected
