"""Positional postings: same answers as over texts, fields, stems, changes and compaction."""

import itertools
import random
import uuid

import pytest

from scenelake.functions.stem import stem
from scenelake.functions.text import parse_query, words_of
from scenelake.operators import search as se
from scenelake.operators.search import SearchRequest, search_assets
from scenelake.schemas import ASSET, LIBRARY, VIDEO_SCENES
from scenelake.plans.search_queries import tag_search
from scenelake.plans.tables import Catalog
from scenelake.sources import text_index as ti


def rows_of(spark, schema, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows], schema)


def analysis(description, tags=(), ocr=None):
    return {"description": description, "tags": None if tags is None else list(tags), "ocr_text": ocr}


def image(i, va, library="a", kind="image"):
    return {"id": i, "library_id": library, "rel_path": f"{i}.jpg", "type": kind, "status": "completed", "visual_analysis": va}


def scene(i, asset_id, start, end, va):
    return {"id": i, "asset_id": asset_id, "start_ts": float(start), "end_ts": float(end), "metadata": None if va is None else {"analysis": va}, "rep_frame_path": f"f{i}.jpg"}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = ["red", "car", "the", "Beach", "beaches", "sun", "Über", "x9", "the"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) + rng.choice(["", ",", ".", "-"]) for _ in range(rng.randrange(12)))])
    made = lambda: analysis(text(), rng.choice([None, [], ["red"], ["Beach", "red", "Beach"], ["the sun"]]), text())
    assets = [image(i, made() if i % 7 else None, rng.choice("ab")) for i in range(1, 61)]
    assets += [image(100 + i, None, rng.choice("ab"), "video") for i in range(6)] + [image(200, analysis("red car"), "gone")]
    scenes = [scene(i, 100 + i % 7, float(i), i + 2.0, made() if i % 5 else None) for i in range(1, 50)]
    import datetime

    library = rows_of(spark, LIBRARY, [{"slug": "a"}, {"slug": "b"}, {"slug": "gone", "deleted_at": datetime.datetime(2024, 1, 1)}])
    return rows_of(spark, ASSET, assets), rows_of(spark, VIDEO_SCENES, scenes), library


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    ti.write_index(ti.build_postings(*tables[:2]), path)
    return ti.read_index(spark, path)


QUERIES = [
    "red", "red car", '"red car"', "red or sun", '"the sun" -car', "beach -beaches or über", '"red the car"', "missing", "x9 x9",
    "the", '"beach sun" or "sun beach"', "-red", "red -\"the sun\"",
]


@pytest.mark.parametrize("query", QUERIES)
def test_same_hits_as_over_texts(tables, index, query):
    for how in ({"query": query}, {"ocr_query": query}, {"query": query, "tag": "red", "full_duration": True}):
        req = SearchRequest(limit=500, include_deleted="car" in query, **how)
        plain = [tuple(r) for r in search_assets(*tables, req).collect()]
        assert [tuple(r) for r in search_assets(*tables, req, index).collect()] == plain, how


def test_tags_and_scopes(tables, index):
    for req in (
        SearchRequest(tag="Beach", limit=500), SearchRequest(tag="beach"), SearchRequest(query="red", libraries=("b",)),
        SearchRequest(query="red", types=("video",)), SearchRequest(query="the sun of", tag="the sun"), SearchRequest(),
    ):
        assert search_assets(*tables, req, index).collect() == search_assets(*tables, req).collect()


def test_plan_reads_terms_and_no_text(spark, tables, index, tmp_path):
    for i, t in enumerate(tables):
        t.write.parquet(f"{tmp_path}/{i}")
    stored = [spark.read.schema(t.schema).parquet(f"{tmp_path}/{i}") for i, t in enumerate(tables)]
    hits = search_assets(*stored, SearchRequest(query='"red car" -sun'), index)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [car,red,sun])" in plan and "EqualTo(field,word)" in plan
    assert "description" not in plan.replace("described", "") and "ocr_text" not in plan


def test_an_exclusion_alone_has_no_postings(tables, index):
    with pytest.raises(ValueError):
        se.found_at(index, parse_query("-red"))
    stems = ti.TextIndex(index.postings, index.tombstones, True)
    with pytest.raises(ValueError):
        search_assets(*tables, SearchRequest(query="-red"), stems)


def test_stems_find_other_forms(spark, tables, tmp_path):
    asset = rows_of(spark, ASSET, [
        image(1, analysis("two beaches at night")), image(2, analysis("A Beach")), image(3, analysis("generally beached")), image(4, analysis("bead")),
    ])
    postings = ti.build_postings(asset, tables[1].where("false"))
    words = ti.word_stems(postings)
    assert words.count() == words.select("term").distinct().count()
    ti.write_index(ti.stemmed_postings(postings, words), str(tmp_path))
    stems = ti.read_index(spark, str(tmp_path), stemmed=True)
    find = lambda q: sorted(r["asset_id"] for r in search_assets(asset, tables[1], tables[2], SearchRequest(query=q), stems).collect())
    assert find("beaches") == [1, 2, 3] and find("generals") == [3] and find('"two beach"') == [1]
    plain = SearchRequest(query="beaches")
    assert [r["asset_id"] for r in search_assets(asset, tables[1], tables[2], plain).collect()] == [1]


def test_stem_samples():
    pairs = (
        "consign consigned consigning consignment|consign; consistency consistent consistently|consist; knaves knave|knave;"
        "knackeries|knackeri; knightly|knight; hopping|hop; hoped hoping|hope; happy|happi; cries cry|cri; by|by; say|say; ties|tie;"
        "gas|gas; this|this; gaps|gap; luxuriating|luxuri; relational|relat; communism|communism; generate|generat; news|news;"
        "succeeded|succeed; analogies|analog; youth|youth; enjoy|enjoy; rational|ration; conspicuously|conspicu; kneel kneeled|kneel"
    )
    for line in pairs.split(";"):
        words, want = line.strip().split("|")
        assert {stem(w) for w in words.split()} == {want}


def found(index, word):
    return sorted((r["kind"], r["id"]) for r in se.found_at(index, parse_query(word)).collect())


def test_changes_and_compaction(spark, tmp_path):
    asset = rows_of(spark, ASSET, [image(i, analysis(f"old thing{i}")) for i in range(1, 6)] + [image(9, None, kind="video")])
    scenes = rows_of(spark, VIDEO_SCENES, [scene(i, 9, i, i + 1, analysis("old scene")) for i in (1, 2)])
    path = f"{tmp_path}/a"
    ti.write_index(ti.build_postings(asset, scenes), path)
    outbox = spark.createDataFrame(
        [(1, 1, "DELETE"), (2, 2, "DELETE"), (3, 2, "UPSERT"), (4, 3, "UPSERT"), (5, 3, "DELETE"), (6, 9, "UPSERT"), (7, 4, "UPSERT"), (8, None, "DELETE"), (9, 77, "DELETE")],
        "seq int, asset_id long, action string",
    )
    now = rows_of(spark, ASSET, [image(2, analysis("new thing2")), image(5, analysis("not queued")), image(9, None, kind="video")])
    new_scenes = rows_of(spark, VIDEO_SCENES, [scene(3, 9, 0, 1, analysis("new scene"))])
    before = sorted(p.name for p in (tmp_path / "a/postings/batch=0").iterdir())
    for _ in range(2):  # the same version again changes nothing
        ti.apply_changes(outbox, now, new_scenes, path, 1)
        index = ti.read_index(spark, path)
        assert found(index, "old") == [("image", 5)] and found(index, "new") == [("image", 2), ("scene", 3)]
    assert sorted(p.name for p in (tmp_path / "a/postings/batch=0").iterdir()) == before
    whole = ti.compact(spark, path, f"{tmp_path}/b")
    assert found(whole, "old") == found(index, "old") and found(whole, "new") == found(index, "new")
    assert whole.tombstones.count() == 0 and whole.postings.count() < index.postings.count()
    # Versions go on after a compaction.
    ti.apply_changes(spark.createDataFrame([(1, 2, "DELETE"), (2, 5, "UPSERT")], "seq int, asset_id long, action string"), now, new_scenes, f"{tmp_path}/b", 2)
    last = ti.read_index(spark, f"{tmp_path}/b")
    assert found(last, "new") == [("scene", 3)] and found(last, "old") == [] and found(last, "queued") == [("image", 5)]
    with pytest.raises(ValueError):
        ti.apply_changes(outbox, now, new_scenes, path, 0)


def test_merged_is_per_asset(spark):
    rows = spark.createDataFrame(list(itertools.product((1, 2, None), (0, 1, 2))), "asset_id long, version long")
    marks = spark.createDataFrame([(1, 2), (1, 1), (2, 1)], ti.TOMBSTONE)
    assert sorted(tuple(r) for r in ti.merged(rows, marks).collect() if r[0]) == [(1, 2), (2, 1), (2, 2)]
    assert ti.merged(rows, marks.where("false")).count() == 9


@pytest.mark.parametrize("at_once", [3, 1 << 18])
def test_postings_are_made_without_a_shuffle(tables, monkeypatch, at_once):
    monkeypatch.setattr(ti, "WORDS_AT_ONCE", at_once)
    asset, scene_rows, _ = tables
    plain, stems = (ti.build_postings(asset, scene_rows, stems=s) for s in (False, True))
    for made in (plain, stems):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    whole = ti.stemmed_postings(plain, ti.word_stems(plain.where("field = 'word'")))
    assert sorted(map(str, stems.collect())) == sorted(map(str, whole.collect()))
    expected = {}
    for r in asset.where("type = 'image' and visual_analysis is not null").collect():
        va = r["visual_analysis"]
        fields = (va["description"], " ".join(va["tags"] or ()), va["ocr_text"])
        for at, word in enumerate((w for f in fields for w in words_of(f or "")), 1):
            expected.setdefault((r["id"], word), []).append(at)
    rows = plain.where("field = 'word' and kind = 'image'").collect()
    assert {(r["id"], r["term"]): r["places"] for r in rows} == expected and len(rows) == len(expected)
    words = [r[0] for r in ti.different_words(asset, scene_rows).collect()]
    assert sorted(words) == sorted({r["term"] for r in plain.where("field = 'word'").collect()})


def test_repeated_rows_are_found_once(tables, spark, tmp_path):
    asset = rows_of(spark, ASSET, [image(1, analysis("red car"))] * 2 + [image(2, analysis("red"))])
    ti.write_index(ti.build_postings(asset, tables[1].where("false")), str(tmp_path))
    found = se.found_at(ti.read_index(spark, str(tmp_path)), parse_query("red")).collect()
    assert sorted((r["id"], r["rank"]) for r in found) == [(1, 0.1), (2, 0.1)]


def test_texts_are_read_once_for_an_index(spark, tables, tmp_path):
    plan = ti.build_postings(*tables[:2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan ") == 2
    marks = tmp_path / "marks"
    marks.mkdir()

    def run(batches):
        (marks / uuid.uuid4().hex).touch()
        yield from batches

    postings = ti.build_postings(*tables[:2]).coalesce(1)
    ti.write_index(postings.mapInArrow(run, postings.schema), f"{tmp_path}/index")
    assert len(list(marks.iterdir())) == 1
    assert ti.read_index(spark, f"{tmp_path}/index").postings.count() == postings.count()


def test_an_index_is_written_without_a_shuffle(spark, tables, tmp_path, monkeypatch):
    path, plans, write = f"{tmp_path}/index", [], ti._write

    def seen(rows, at, version):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, at, version)

    monkeypatch.setattr(ti, "_write", seen)
    ti.write_index(ti.build_postings(*tables[:2]), path)
    assert "Exchange" not in plans[0]
    ti.write_tombstones(spark.range(1, 3).withColumnRenamed("id", "asset_id"), path, 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ti.compact(spark, path, f"{tmp_path}/whole")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plans[-1] and "BroadcastHashJoin" in plans[-1]


@pytest.mark.parametrize("at_once", [4, 1 << 20])
def test_postings_come_in_runs_by_term(spark, tables, monkeypatch, at_once):
    monkeypatch.setattr(ti, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(ti, "POSTINGS_AT_ONCE", at_once)
    asset = rows_of(spark, ASSET, [image(i, analysis(f"zebra ärger w{i % 3} apple été", ["b", "a"])) for i in range(1, 9)])
    made = ti.build_postings(asset.coalesce(1), tables[1].where("false"))
    for postings, run in ((made, 7 if at_once == 4 else 56), (ti.in_runs(made.orderBy("id", "term").coalesce(1)), 56)):
        rows = [(r["field"], r["term"].encode(), r["id"]) for r in postings.collect()]
        assert sorted(rows) == sorted((r["field"], r["term"].encode(), r["id"]) for r in made.collect()) and len(rows) == 8 * 9
        words = [r for r in rows if r[0] == "word"]
        assert all(words[i : i + run] == sorted(words[i : i + run]) for i in range(0, 56, run))


def test_changes_are_kept_apart_from_the_index_they_change(spark, tmp_path):
    asset = rows_of(spark, ASSET, [image(i, analysis(f"old thing{i}")) for i in range(1, 6)])
    scenes = rows_of(spark, VIDEO_SCENES, [])
    ti.write_index(ti.build_postings(asset, scenes), f"{tmp_path}/base")
    base = ti.read_index(spark, f"{tmp_path}/base")
    outbox = spark.createDataFrame([(1, 1, "DELETE"), (2, 2, "UPSERT")], "seq int, asset_id long, action string")
    now = rows_of(spark, ASSET, [image(2, analysis("new thing2"))])
    ti.apply_changes(outbox, now, scenes, f"{tmp_path}/changes", 1)
    assert [p.name for p in (tmp_path / "changes/postings").iterdir()] == ["batch=1"]
    both = ti.read_index(spark, f"{tmp_path}/changes", base=base)
    whole = ti.compact(spark, f"{tmp_path}/changes", f"{tmp_path}/whole", base=base)
    for index in (both, whole):
        assert found(index, "old") == [("image", i) for i in (3, 4, 5)] and found(index, "new") == [("image", 2)]
    assert found(base, "old") == [("image", i) for i in range(1, 6)] and whole.tombstones.count() == 0


def test_tags_are_indexed_without_reading_texts(spark, tables, tmp_path):
    asset, scene_rows, library = tables
    whole, tags = (ti.build_postings(asset, scene_rows, words=w) for w in (True, False))
    keys = ("kind", "id", "asset_id", "start_ts", "end_ts", "field", "term", "places", "version")
    assert sorted(map(str, tags.select(*keys).collect())) == sorted(map(str, whole.where("field = 'tag'").select(*keys).collect()))
    assert tags.count() > 0
    asset.write.parquet(f"{tmp_path}/asset"), scene_rows.write.parquet(f"{tmp_path}/scene")
    stored = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("asset", "scene")]
    plan = ti.build_postings(*stored, words=False)._jdf.queryExecution().executedPlan().toString()
    assert "tags" in plan and "ocr_text:" not in plan and "description:" not in plan


def test_tag_search_needs_no_postings_of_words(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    assert tag_search(c).count() > 0 and list(c._indexes) == ["tags"]
