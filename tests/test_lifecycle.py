import datetime

import pytest

from scenelake.operators import catalog as cat
from scenelake.operators import lifecycle as life
from scenelake.schemas import AIMODEL, ASSET, LIBRARY, LIBRARY_MODEL_POLICY, PROJECT, PROJECT_ASSETS

DELETED = datetime.datetime(2024, 1, 1)


def table(spark, schema, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)


@pytest.fixture(scope="module")
def library(spark):
    return table(
        spark, LIBRARY, {"slug": "a", "absolute_path": "/m/a"}, {"slug": "gone", "deleted_at": DELETED, "absolute_path": "/m/g"},
    )


def _assets(spark, names, lib="a"):
    return table(spark, ASSET, *[{"id": i, "library_id": lib, "rel_path": n, "type": "image"} for i, n in enumerate(names, 1)])


def _manifest(spark, library, names):
    members = spark.createDataFrame([(1, i) for i in range(1, len(names) + 1)], PROJECT_ASSETS)
    rows = life.export_manifest(members, _assets(spark, names), library).orderBy("asset_id").collect()
    return [r["dest_name"] for r in rows]


def test_manifest_names(spark, library):
    assert _manifest(spark, library, ["x/a.jpg", "y/a.jpg", "z/a.jpg", "b.jpg", "q/noext", "r/noext"]) == [
        "a.jpg", "a_2.jpg", "a_3.jpg", "b.jpg", "noext", "noext_2"]


def test_manifest_avoids_literal_names(spark, library):
    names = ["x/a.jpg", "y/a.jpg", "z/a.jpg", "w/a.jpg", "a_2.jpg", "a_4.jpg", "o/a_4.jpg", "a_03.jpg"]
    got = _manifest(spark, library, names)
    assert got == ["a.jpg", "a_3.jpg", "a_5.jpg", "a_6.jpg", "a_2.jpg", "a_4.jpg", "a_4_2.jpg", "a_03.jpg"]


def test_manifest_is_collision_free(spark, library):
    import random

    rng = random.Random(4)
    names = [f"{i}/" + rng.choice(["a", "a_2", "a_2_2", "a_3", "b_7", "b"]) + rng.choice([".jpg", ""]) for i in range(150)]
    got = _manifest(spark, library, names)
    assert len(set(got)) == len(names)
    first = {}
    for source, dest in zip(names, got):
        base = source.split("/")[1]
        if base not in first:
            first[base] = dest
            assert dest == base


def test_policy_transitions(spark):
    policy = table(
        spark, LIBRARY_MODEL_POLICY,
        {"library_slug": "a", "active_index_name": "i1", "locked": False, "promotion_progress": 0.0},
        {"library_slug": "b", "active_index_name": "j1", "locked": False, "promotion_progress": 0.0},
    )

    def row(df, slug="a"):
        return df.where(f"library_slug='{slug}'").first()

    shadowed = life.begin_shadow(policy, "a", "i2", 1_700_000_000)
    assert row(shadowed)["locked"] and row(shadowed)["locked_since"] is not None
    assert row(life.set_progress(shadowed, "a", 1.7))["promotion_progress"] == 1.0
    assert row(life.set_progress(shadowed, "a", -1))["promotion_progress"] == 0.0
    promoted = life.promote(shadowed)
    assert (row(promoted)["active_index_name"], row(promoted)["previous_index_name"], row(promoted)["locked"]) == ("i2", "i1", False)
    assert row(promoted, "b")["active_index_name"] == "j1"
    back = life.rollback_library(promoted, "a")
    assert (row(back)["active_index_name"], row(back)["shadow_index_name"], row(back)["previous_index_name"]) == ("i1", "i2", None)
    with pytest.raises(ValueError):
        life.rollback_library(back, "a")
    replaced = life.upsert_policies(policy, promoted.where("library_slug='a'"))
    assert row(replaced)["active_index_name"] == "i2" and replaced.count() == 2
    assert life.delete_policies(policy, ["a"]).count() == 1


def test_libraries(spark, library):
    asked = spark.createDataFrame([("A", "/x"), ("Gone!", "/y"), ("New one", "/z"), ("???", "/q")], "name string, absolute_path string")
    new, rejected = life.add_libraries(library, asked)
    assert sorted(r["slug"] for r in new.collect()) == ["a", "gone", "library", "new-one"]
    reasons = {r["slug"]: r["reason"] for r in rejected.collect()}
    assert "active" in reasons["a"] and "trash" in reasons["gone"]
    with pytest.raises(ValueError):
        life.require_trashed(library, "a")
    with pytest.raises(ValueError):
        life.require_trashed(library, "nope")
    life.require_trashed(library, "gone")
    assert {r["folder"] for r in life.purged_folders(library).collect()} == {"gone", "tmp/gone", "video_clips/gone", "video_scenes/gone"}


def test_guarded_delete(spark):
    asset = _assets(spark, ["1.jpg", "2.jpg"])
    members = spark.createDataFrame([(1, 2)], PROJECT_ASSETS)
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    left, refused = life.delete_assets(ids, members, {"asset": asset})
    assert [r["id"] for r in left["asset"].collect()] == [2] == [r["id"] for r in refused.collect()]


def test_projects(spark, library):
    project = table(spark, PROJECT, {"id": 4, "name": "p"})
    asked = spark.createDataFrame([(" New ", None), ("  ", None)], "name string, export_path string")
    made = life.create_projects(project, asked, 1_700_000_000)
    assert [(r["id"], r["name"]) for r in made.orderBy("id").collect()] == [(4, "p"), (5, "New")]
    asset = _assets(spark, ["1.jpg", "2.jpg"])
    members = spark.createDataFrame([(4, 1)], PROJECT_ASSETS)
    add = spark.createDataFrame([(4, 1), (4, 2), (9, 1), (4, 77)], PROJECT_ASSETS)
    grown = life.add_to_projects(members, add, project, cat.live_assets(asset, library))
    assert sorted(map(tuple, grown.collect())) == [(4, 1), (4, 2)]
    assert life.remove_from_projects(grown, members).count() == 1


def test_models(spark):
    models = table(spark, AIMODEL, {"id": 1, "name": "m", "version": "1"}, {"id": 2, "name": "m", "version": "2"}, {"id": 3, "name": "n", "version": "1"})
    cards = spark.createDataFrame([("m", "2"), ("o", "1")], "name string, version string")
    assert sorted(map(tuple, cat.register_models(models, cards).collect()))[-1] == (4, "o", "1")
    assert cat.model_by_name(models, "m").first()["id"] == 2
    asset = table(spark, ASSET, {"id": 1, "analysis_model_id": 1})
    names = spark.createDataFrame([("m",), ("n",)], "name string")
    assert {r["id"] for r in cat.remove_models(models, asset, names).collect()} == {1, 2}


def test_scope_guard():
    assert cat.require_scope("a", False) == "a" and cat.require_scope(None, True) is None
    for bad in (("a", True), (None, False)):
        with pytest.raises(ValueError):
            cat.require_scope(*bad)
