import pytest

from scenelake.operators.search import SearchRequest, result_rows, search_assets
from scenelake.schemas import ASSET, LIBRARY, VIDEO_SCENES


def _va(description, tags=(), ocr=None):
    return {"description": description, "tags": list(tags), "ocr_text": ocr}


def _rows(spark, schema, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)


@pytest.fixture(scope="module")
def tables(spark):
    import datetime

    library = _rows(spark, LIBRARY, [
        {"slug": "a", "name": "A"}, {"slug": "b"},
        {"slug": "gone", "deleted_at": datetime.datetime(2024, 1, 1)},
    ])

    def image(i, lib, va):
        return {"id": i, "library_id": lib, "rel_path": f"d/{i}.jpg", "type": "image", "status": "completed", "visual_analysis": va}

    asset = _rows(spark, ASSET, [
        image(1, "a", _va("man in blue shirt", ["blue", "shirt"])),
        image(2, "a", _va("blue sky and far away a shirt")),
        image(3, "b", _va("lunch", ["food"], "hamburger and fries")),
        image(4, "gone", _va("blue shirt")),
        image(5, "a", None),
        {"id": 10, "library_id": "a", "rel_path": "v.mp4", "type": "video", "status": "completed"},
    ])

    def scene(i, start, end, va):
        return {"id": i, "asset_id": 10, "start_ts": start, "end_ts": end, "description": va["description"],
                "metadata": {"analysis": va}, "rep_frame_path": f"f{i}.jpg"}

    scenes = _rows(spark, VIDEO_SCENES, [
        scene(1, 0.0, 5.0, _va("sunset beach", ["beach"])), scene(2, 5.0, 10.0, _va("person indoors", ["room"])),
        scene(3, 12.0, 14.0, _va("sunset beach", ["beach"])),
    ])
    return asset, scenes, library


def _search(tables, **how):
    return search_assets(*tables, SearchRequest(**how)).collect()


def test_image_search(tables):
    hits = _search(tables, query="blue shirt")
    assert [h["asset_id"] for h in hits] == [1, 2]
    assert hits[0]["match_ratio"] == 1.0 and hits[0]["best_scene_ts"] is None


def test_deleted_libraries_only_on_request(tables):
    assert 4 in [h["asset_id"] for h in _search(tables, query="blue shirt", include_deleted=True)]


def test_ocr_search(tables):
    assert [h["asset_id"] for h in _search(tables, ocr_query="hamburger")] == [3]
    assert _search(tables, ocr_query="lunch") == []


def test_video_density(tables):
    (hit,) = _search(tables, query="sunset")
    assert (hit["asset_id"], hit["best_scene_ts"], hit["best_rep_frame_path"]) == (10, 0.0, "f1.jpg")
    assert hit["match_ratio"] == pytest.approx(7 / 14)
    (early,) = _search(tables, query="indoors")
    assert early["match_ratio"] == pytest.approx(5 / 10)
    (full,) = _search(tables, query="indoors", full_duration=True)
    assert full["match_ratio"] == pytest.approx(5 / 14)


def test_tags(tables):
    assert [h["asset_id"] for h in _search(tables, tag="beach")] == [10]
    assert _search(tables, tag="nothing") == []
    assert _search(tables, query="sunset", tag="room") == []


def test_scope_and_empty_queries(tables):
    assert _search(tables, query="blue", libraries=("b",)) == []
    assert _search(tables, query="sunset", types=("image",)) == []
    assert _search(tables) == [] and _search(tables, query="the") == []
    with pytest.raises(ValueError):
        _search(tables, query="x", limit=0)


def test_result_rows(tables, spark):
    asset, scenes, library = tables
    hits = search_assets(asset, scenes, library, SearchRequest(query="sunset"))
    row = result_rows(hits, asset, library).first()
    assert row["preview_url"] == "/media/f1.jpg" and row["best_scene_ts"] == "00:00"
    assert row["library_name"] == "A" and row["match_ratio"] == 50.0 and row["filename"] == "v.mp4"


def test_one_entry_point_routes_and_flags(spark):
    from scenelake.operators.find import find
    from scenelake.operators.search import SearchRequest
    from scenelake.plans.tables import open_catalog

    c = open_catalog(spark, "/root/testdata/sf0.001")
    tables = (c.asset, c.scene, c.library, c.policy, c.documents, c.postings)
    by_index = find(*tables, SearchRequest(query="the", limit=10)).collect()
    assert by_index and {r["searched"] for r in by_index} == {"index"}
    by_tag = find(*tables, SearchRequest(tag="en", limit=10)).collect()
    assert {r["searched"] for r in by_tag} <= {"catalog"}
    assert len({r["incomplete"] for r in by_index}) == 1


def test_documents_are_not_made_without_an_index(spark):
    from scenelake.operators.find import find
    from scenelake.plans.tables import open_catalog

    def never():
        raise AssertionError("no library has an index")

    c = open_catalog(spark, "/root/testdata/sf0.001")
    req = SearchRequest(query="thing", limit=10)
    rows = find(c.asset, c.scene, c.library, c.policy.where("false"), never, never, req).collect()
    assert rows and {r["searched"] for r in rows} == {"catalog"}
    routed = find(c.asset, c.scene, c.library, c.policy, lambda: c.documents, lambda: c.postings, req).collect()
    assert routed and "index" in {r["searched"] for r in routed}
