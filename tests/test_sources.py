import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from scenelake.plans.tables import AS_OF, open_catalog
from scenelake.session import store
from scenelake.sources import inventory, records
from scenelake.sources import search_docs as sd
from scenelake.streaming.sync import sync_batch

SF = "/root/testdata/sf0.001"


def test_scan_library(spark, tmp_path):
    for name, size in (("a/x.JPG", 3), ("a/b/y.mp4", 5), ("z.txt", 1), ("w.raw", 0)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"0" * size)
    (tmp_path / "link.jpg").symlink_to(tmp_path / "a/x.JPG")
    os.utime(tmp_path / "a/x.JPG", (1_700_000_000.1234, 1_700_000_000.1234))
    rows = {r["rel_path"]: r for r in inventory.scan_library(spark, "lib", str(tmp_path)).collect()}
    assert set(rows) == {"a/x.JPG", "a/b/y.mp4", "w.raw"}
    assert (rows["a/x.JPG"]["type"], rows["a/x.JPG"]["size"], rows["a/x.JPG"]["mtime"]) == ("image", 3, 1_700_000_000.123)
    assert rows["w.raw"]["size"] == 0
    assert rows["a/b/y.mp4"]["type"] == "video" and rows["a/b/y.mp4"]["ext"] == "mp4"


def test_raw_metadata(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text("\n".join(json.dumps(d) for d in (
        {"SourceFile": "/a.jpg", "Make": "Canon", "ImageWidth": 100, "MakerNoteX": "b", "Serial": "1"}, {"SourceFile": "/b.jpg"})))
    rows = {r["source_file"]: r["raw_exif"] for r in inventory.read_raw_metadata(spark, str(path), ["SERIAL"]).collect()}
    assert rows == {"/a.jpg": {"Make": "Canon", "ImageWidth": "100"}, "/b.jpg": {}}


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, x string")
    assert json.loads(records.as_json(df).first()["json"]) == {"id": 1, "x": None}
    text = spark.createDataFrame([("a\nb",), ("x" * 80,), (None,)], "t string").select(records.clip_description(F.col("t")))
    assert [r[0] for r in text.collect()] == ["a b", "x" * 57 + "...", "—"]


def test_manifest_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.jpg")], "asset_id bigint, dest_name string")
    records.write_manifest(df, str(tmp_path / "m"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first()["dest_name"] == "a.jpg"
    with pytest.raises(Exception):
        records.write_manifest(df, str(tmp_path / "m"), "csv")


def test_index_lifecycle(spark, tmp_path):
    c = open_catalog(spark, SF)
    path, posted = str(tmp_path / "docs"), str(tmp_path / "postings")
    first = sync_batch(c.asset, c.scene, c.library, c.policy, path, posted, AS_OF)
    docs = sd.read_documents(spark, path)
    done = c.asset.where("status = 'completed'")
    live = done.join(c.library.where("deleted_at is null"), F.col("slug") == F.col("library_id"), "left_semi")
    assert first.cursor == live.agg(F.max("id")).first()[0]
    assert docs.where("scene_id = 0").select("asset_id").distinct().count() == docs.where("scene_id = 0").count()
    before = docs.count(), sd.read_documents(spark, posted).count()
    again = sync_batch(c.asset, c.scene, c.library, first.policy, path, posted, AS_OF, first.cursor)
    assert again.cursor == first.cursor and again.left_out.isEmpty()
    # The same batch once more, as after a failure: nothing is written twice.
    sync_batch(c.asset, c.scene, c.library, first.policy, path, posted, AS_OF)
    assert (sd.read_documents(spark, path).count(), sd.read_documents(spark, posted).count()) == before
    docs = sd.read_documents(spark, path)
    without = {r[0] for r in first.left_out.select("asset_id").collect()}
    assert without == {r[0] for r in live.select("id").collect()} - {r[0] for r in docs.select("asset_id").collect()}
    names = {r[0] for r in docs.select("index_name").distinct().collect()}
    name = sorted(n for n in names if n.startswith("media_scenes_src1_"))[0]
    with pytest.raises(ValueError):
        sd.create_index(spark, path, name)
    sd.create_index(spark, path, "fresh")
    assert sd.delete_index(spark, path, "fresh") and not sd.delete_index(spark, path, "fresh")
    other = sorted(names - {name})[0]
    assert sd.delete_index(spark, path, other, posted) and not sd.delete_index(spark, path, other, posted)
    for table in (path, posted):
        assert sd.read_documents(spark, table).where(F.col("index_name") == other).count() == 0
    left = sd.reset_sync(spark, path, c.policy, ["src1"], postings=posted)
    assert left.where("library_slug = 'src1'").count() == 0 and left.count() == c.policy.count() - 1
    for table in (path, posted):
        assert sd.read_documents(spark, table).where(F.col("index_name") == name).count() == 0
    sd.reset_sync(spark, path, c.policy, checkpoint=str(tmp_path / "none"))


def test_a_library_without_policy_keeps_one_index(spark, tmp_path):
    c = open_catalog(spark, SF)
    path, posted = str(tmp_path / "docs"), str(tmp_path / "postings")
    stored = {"policy": c.policy.where("library_slug <> 'src2'")}
    half = c.asset.agg(F.percentile_approx("id", F.lit(0.5))).first()[0]
    cursor = None
    for asset, as_of in ((c.asset.where(F.col("id") <= half), 100), (c.asset, 200)):
        done = sync_batch(asset, c.scene, c.library, stored["policy"], path, posted, as_of, cursor)
        stored["policy"], cursor = done.policy, done.cursor
    docs = sd.read_documents(spark, path).where("library_slug = 'src2'")
    assert {r[0] for r in docs.select("index_name").collect()} == {"media_scenes_src2_100"}
    assert stored["policy"].where("library_slug = 'src2'").first()["active_index_name"] == "media_scenes_src2_100"
    assert docs.count() == docs.select("id").distinct().count() > 0


def test_filters_and_partitions_reach_the_files(spark):
    from scenelake.operators import catalog as cat
    from scenelake.operators import ranking as rk

    c = open_catalog(spark, SF)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")

    def plan_of(df):
        return df._jdf.queryExecution().explainString(formatted)

    plan = plan_of(cat.eligible_work(c.asset, c.library, "proxied", ["jpg", "png"], AS_OF))
    assert "In(ext, [jpg,png])" in plan and "BroadcastHashJoin" in plan
    plan = plan_of(rk.shadow_search(c.documents, "media_scenes_src1_200", c.library, "the"))
    assert "PartitionFilters: [isnotnull(index_name" in plan
    plan = plan_of(rk.bm25_scores(c.documents, {"the": 1, "of": 1}, True, c.postings))
    assert "In(term, [of,the])" in plan


def test_unreadable_folders_are_rows_and_hide_what_is_below(spark, tmp_path):
    from scenelake.operators.maintenance import missing_sources
    from scenelake.sources import inventory

    with pytest.raises(FileNotFoundError):
        inventory.list_files(spark, str(tmp_path / "none"))
    taken = inventory.take_inventory(spark, str(tmp_path / "none"))
    assert taken.files.isEmpty() and [r["path"] for r in taken.unreadable.collect()] == [""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_text("x")
    whole = inventory.take_inventory(spark, str(tmp_path / "in"))
    assert [r["path"] for r in whole.files.collect()] == ["a.jpg"] and whole.unreadable.isEmpty()
    c = open_catalog(spark, SF)
    nothing = c.source_file.where("false")
    gone = missing_sources(c.asset, c.library, c.project_assets, nothing)
    one = gone.where("rel_path like '%/%'").first()
    folder = one["rel_path"].rsplit("/", 1)[0]
    closed = spark.createDataFrame([(one["library_id"], folder)], "library_id string, path string")
    left = missing_sources(c.asset, c.library, c.project_assets, nothing, closed)
    below = (F.col("library_id") == one["library_id"]) & F.col("rel_path").startswith(folder + "/")
    assert left.where(below).isEmpty() and left.count() == gone.where(~below).count()
    root = spark.createDataFrame([(one["library_id"], "")], "library_id string, path string")
    assert missing_sources(c.asset, c.library, c.project_assets, nothing, root).where(
        F.col("library_id") == one["library_id"]
    ).isEmpty()


def test_a_folder_that_cannot_be_listed(monkeypatch):
    from scenelake.sources import inventory

    def refuse(path):
        raise PermissionError("no")

    monkeypatch.setattr(inventory.os, "scandir", refuse)
    assert list(inventory._entries("/x/y")) == [("/x/y", None, None, None, "no")]


def test_libraries_are_stored_apart(spark):
    c = open_catalog(spark, SF)
    files = c.asset.select(F.input_file_name().alias("f"), "library_id", "id")
    parts = files.groupBy("f").agg(F.min("library_id").alias("a"), F.max("library_id").alias("b")).orderBy("a", "b").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(parts, parts[1:]))


def test_postings_are_counted_in_their_texts_rows_and_once(spark, tmp_path):
    rows = [(f"asset_{i}", i, "a b a " * i + "The the", None, ["x y"], f"i{i % 2}", "b0") for i in range(1, 30)]
    docs = spark.createDataFrame(
        rows, "id string, asset_id bigint, description string, ocr_text string, tags array<string>, index_name string, batch_id string"
    )
    postings = sd.build_postings(docs)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    marks = tmp_path / "marks"
    marks.mkdir()

    def run(batches):
        (marks / uuid.uuid4().hex).touch()
        yield from batches

    sd.write_postings(postings.coalesce(1).mapInArrow(run, postings.schema), f"{tmp_path}/postings", "0")
    assert len(list(marks.iterdir())) == 1
    read = sd.read_documents(spark, f"{tmp_path}/postings")
    got = {(r["index_name"], r["asset_id"], r["length"], r["term"], r["tf"]) for r in read.collect()}
    want = {
        (f"i{i % 2}", i, 3 * i + 4, w, n) for i in range(1, 30)
        for w, n in (("a", 2 * i), ("b", i), ("the", 2), ("x", 1), ("y", 1))
    }
    assert got == want and read.count() == len(want)


def test_rows_of_one_table_are_stored_as_they_are_read(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4)
    assert store(rows, f"{tmp_path}/a", as_read=True).count() == 100
    assert len(list((tmp_path / "a").glob("part-*"))) == 4
