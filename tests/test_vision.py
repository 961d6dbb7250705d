import pytest

from scenelake.functions.frames import token_set_similarity
from scenelake.operators import vision
from scenelake.operators.catalog import nearest_scene
from scenelake.plans.tables import open_catalog
from scenelake.schemas import VIDEO_SCENES, invalid_rows

SF = "/root/testdata/sf0.001"


def _scenes(spark, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in VIDEO_SCENES.fields} for r in rows], VIDEO_SCENES)


def _analysis(**values):
    return {"analysis": {"description": None, "tags": None, "ocr_text": None, "ocr_done": None, **values}}


def test_analyser_runs_and_is_pluggable(spark):
    images = spark.createDataFrame([(1, b"x"), (2, b"yy")], "id bigint, image binary")
    row = vision.analyze_images(images).first()
    assert row["tags"] == ["mock", "test"] and row["model_name"] == "mock-analyzer"
    vision.register_analyzer("length", lambda image, mode: (f"{mode} {len(image)}", [], None), "len", "2")
    got = {r["id"]: r["description"] for r in vision.analyze_images(images, "length", "light").collect()}
    assert got == {1: "light 1", 2: "light 2"}
    with pytest.raises(ValueError):
        vision.analyze_images(images, "nobody")


def test_absent_text_is_not_empty_text(spark):
    scene = _scenes(
        spark, {"id": 1, "asset_id": 1, "description": "d", "metadata": _analysis(ocr_done=True)},
        {"id": 2, "asset_id": 1, "description": "d", "metadata": _analysis()}, {"id": 3, "asset_id": 2, "description": "d"},
        {"id": 4, "asset_id": 3, "description": "d", "metadata": _analysis(ocr_done=True)}, {"id": 5, "asset_id": 4},
    )
    assert sorted(r["id"] for r in vision.scenes_needing_ocr(scene).collect()) == [2, 3]
    assert [r["asset_id"] for r in vision.completable_videos(scene).collect()] == [3]
    results = spark.createDataFrame(
        [(2, "full", None, None, None), (5, "light", "new", ["t"], None)],
        "id bigint, mode string, description string, tags array<string>, ocr_text string",
    )
    rows = {r["id"]: r for r in vision.write_scene_analysis(scene, results).collect()}
    assert rows[2]["metadata"]["analysis"]["ocr_done"] and rows[2]["description"] == "d"
    assert rows[5]["description"] == "new" and rows[5]["metadata"]["analysis"]["tags"] == ["t"]
    assert rows[3]["metadata"] is None


def test_duplicates_equal_brute_force(spark):
    c = open_catalog(spark, SF)
    scenes = c.scene.select("asset_id", "start_ts", "id", "description").collect()
    scenes.sort(key=lambda r: (r["asset_id"], r["start_ts"], r["id"]))
    wanted, before = {}, None
    for r in scenes:
        prev = before["description"] if before is not None and before["asset_id"] == r["asset_id"] else None
        wanted[r["id"]] = bool(prev and r["description"]) and token_set_similarity(prev, r["description"]) > 85
        before = r
    for chunk in (15.0, 3600.0):
        rows = vision.semantic_duplicates(c.scene, chunk_seconds=chunk).collect()
        assert {r["id"]: r["semantic_duplicate"] for r in rows} == wanted


def test_near_copies_are_flagged(spark):
    text = "a red car parked near the old stone bridge"
    scene = _scenes(
        spark, {"id": 1, "asset_id": 1, "start_ts": 0.0, "description": text},
        {"id": 2, "asset_id": 1, "start_ts": 5.0, "description": text + "s"},
        {"id": 3, "asset_id": 1, "start_ts": 9.0, "description": "something else entirely"},
        {"id": 4, "asset_id": 2, "start_ts": 1.0, "description": text},
    )
    got = {r["id"]: r["semantic_duplicate"] for r in vision.semantic_duplicates(scene).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_nearest_scene(spark):
    scene = _scenes(
        spark, {"id": 1, "asset_id": 1, "start_ts": 0.0, "metadata": _analysis(description="one")},
        {"id": 2, "asset_id": 1, "start_ts": 5.0, "metadata": _analysis(description="two")},
        {"id": 3, "asset_id": 1, "start_ts": 5.1},
    )
    moments = spark.createDataFrame([(1, 0.5), (1, 5.2), (1, 2.5), (1, 900.0), (7, 1.0)], "asset_id bigint, ts double")
    for chunk in (1.0, 3600.0):
        got = {r["ts"]: r["analysis"]["description"] for r in nearest_scene(scene, moments, chunk).collect()}
        assert got == {0.5: "one", 5.2: "two", 2.5: "one", 900.0: "two"}


def test_value_sets(spark):
    df = spark.createDataFrame([("exif_done",), ("odd",), (None,)], "metadata_status string")
    from scenelake.schemas import METADATA_STATUSES

    assert [r[0] for r in invalid_rows(df, "metadata_status", METADATA_STATUSES).collect()] == ["odd"]


def test_semantic_duplicates_are_marked_in_the_metadata(spark):
    c = open_catalog(spark, SF)
    flags = {r["id"]: r["semantic_duplicate"] for r in vision.semantic_duplicates(c.scene).collect()}
    marked = vision.mark_semantic_duplicates(c.scene)
    assert marked.columns == c.scene.columns and marked.count() == c.scene.count()
    for r in marked.select("id", "metadata").collect():
        assert r["metadata"] is None or r["metadata"]["semantic_duplicate"] == flags[r["id"]]
