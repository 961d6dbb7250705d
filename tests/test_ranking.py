import pytest
from pyspark.sql import functions as F

from scenelake.operators import ranking as rk
from scenelake.sources.search_docs import build_postings

DOC = (
    "id string, asset_id bigint, scene_id bigint, library_slug string, description string, ocr_text string, "
    "tags array<string>, capture_ts double, sharpness_score double, has_face boolean, camera_make string, "
    "camera_model string, index_name string"
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("asset_1", 1, 0, "a", "red balloon over the sea", None, ["red"], 10.0, 0.9, True, "Canon", "R5", "ia"),
        ("asset_2", 2, 0, "a", "red red balloon", None, [], 20.0, 0.2, False, "Nikon", "Z", "ia"),
        ("scene_7", 3, 7, "b", "a balloon", "RED sign", [], 30.0, None, None, None, None, "ib"),
        ("asset_4", 4, 0, "b", "nothing here", None, [], 40.0, 0.5, True, "Canon", "R6", "ib"),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def library(spark):
    return spark.sql("select * from values ('a', timestamp(null)), ('b', timestamp(null)) as t(slug, deleted_at)")


@pytest.fixture(scope="module")
def with_trash(spark):
    return spark.sql("select * from values ('a', timestamp'2024-01-01'), ('b', null) as t(slug, deleted_at)")


def _ids(df):
    return sorted(r["asset_id"] for r in df.collect())


def test_search(docs, library):
    assert _ids(rk.bm25_search(docs, "red balloon")) == [1, 2, 3]
    assert _ids(rk.bm25_search(docs, "red balloon", libraries=["a"])) == [1, 2]
    assert _ids(rk.bm25_search(docs, "red balloon", types=["video"])) == [3]
    assert _ids(rk.bm25_search(docs, "")) == [] == _ids(rk.bm25_search(docs, "missing red"))
    assert len(_ids(rk.bm25_search(docs, "red", limit=1))) == 1
    assert rk.bm25_search(docs, "red", limit=1).first()["asset_id"] == 2
    assert _ids(rk.shadow_search(docs, "ib", library, "balloon")) == [3]


def test_postings_give_the_same_scores(docs):
    weights = {"red": 2, "balloon": 1, "sea": 1}
    for match_all in (True, False):
        scan = {r["id"]: round(r["score"], 9) for r in rk.bm25_scores(docs, weights, match_all).collect()}
        stored = rk.bm25_scores(docs, weights, match_all, build_postings(docs))
        assert scan == {r["id"]: round(r["score"], 9) for r in stored.collect()} and scan


def test_routing(spark, docs, library):
    policy = spark.createDataFrame([("a", "ia"), ("b", None)], "library_slug string, active_index_name string")
    assert _ids(rk.routed_search(docs, policy, library, "balloon")) == [1, 2]
    assert rk.has_active_index(policy, ["a"]) and not rk.has_active_index(policy, ["b"])


@pytest.mark.parametrize("scope,expected", [
    ({}, [2, 3, 4]), ({"library": "b"}, [3, 4]), ({"library": "all"}, [2, 3, 4]), ({"asset_types": ("image",)}, [2, 4]),
    ({"asset_types": ("video",)}, [3]), ({"asset_types": ("image", "video")}, [2, 3, 4]),
    ({"from_ts": 20.0, "to_ts": 30.0}, [2, 3]), ({"min_sharpness": 0.5}, [4]), ({"has_face": False}, [2]),
    ({"cameras": (rk.Camera("Canon", "R5"), rk.Camera(" Nikon "))}, [2]), ({"cameras": (rk.Camera(),)}, [2, 3, 4]),
])
def test_scope(docs, scope, expected):
    assert _ids(docs.where(rk.SimilarityScope(**scope).condition(1))) == expected


def test_thresholds():
    assert rk.thresholds(0.65, 0.35, 0.1) == [0.65, 0.55, 0.45000000000000007, 0.3500000000000001]
    assert rk.thresholds(0.65, 0.35, 0.0) == [0.65] and rk.thresholds(0.2, 0.35, 0.1) == []


@pytest.mark.parametrize("scores,threshold,kept", [
    ([0.9, 0.8, 0.7, 0.4], 0.65, 3), ([0.9, 0.6, 0.5, 0.4], 0.45000000000000007, 3), ([0.5, None], 0.3500000000000001, 1),
    ([0.1], None, 0),
])
def test_adaptive_cut(spark, scores, threshold, kept):
    hits = spark.createDataFrame([(str(i), s) for i, s in enumerate(scores)], "id string, score double")
    rows = rk.adaptive_cut(hits).collect()
    assert len(rows) == kept
    assert all(r["threshold_used"] == threshold for r in rows)


def test_similar(docs):
    found = rk.find_similar(docs, "a red balloon", ["Red"], 1, min_score=0.0, floor=0.0, step=0.0).collect()
    assert {r["asset_id"] for r in found} == {2, 3}
    assert rk.find_similar(docs, "", [], 1).count() == 0


def test_trash_is_left_out_before_the_cut(spark, docs, with_trash):
    policy = spark.createDataFrame([("a", "ia"), ("b", "ib")], "library_slug string, active_index_name string")
    for postings in (None, build_postings(docs)):
        find = lambda **o: _ids(rk.routed_search(docs, policy, with_trash, "balloon", limit=1, postings=postings, **o))
        assert find() == [3] and find(include_deleted=True) != [3]
    assert _ids(rk.shadow_search(docs, "ia", with_trash, "balloon")) == []


def test_tag_and_ocr_restrict_the_scope(docs):
    for postings in (None, build_postings(docs)):
        assert _ids(rk.bm25_search(docs, "balloon", tag="red", postings=postings)) == [1]
        assert _ids(rk.bm25_search(docs, "red", ocr=True, postings=postings)) == [3]
        assert _ids(rk.bm25_search(docs, "balloon", ocr=True, postings=postings)) == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ocr_scope_is_found_once(spark, docs):
    found = rk.bm25_search(docs, "red", ocr=True, postings=build_postings(docs))
    assert "array_except" not in _plan(found) and _ids(found) == [3]
    twice = docs.withColumn("index_name", F.lit("other")).withColumn("ocr_text", F.lit(None).cast("string")).unionByName(docs)
    rows = rk.bm25_search(twice, "red", ocr=True, postings=build_postings(twice)).collect()
    assert [(r["id"], r["index_name"]) for r in rows] == [("scene_7", "ib")]


def test_similar_without_limits_reads_no_ids_of_documents(docs):
    postings = build_postings(docs)
    find = lambda scope, **o: rk.find_similar(docs, "red balloon", [], 1, scope, min_score=0.0, floor=0.0, **o)
    for scope in (rk.SimilarityScope(), rk.SimilarityScope(asset_types=("image",)), rk.SimilarityScope(library="b")):
        found = find(scope, postings=postings)
        assert "LeftSemi" not in _plan(found) and _ids(found) == _ids(find(scope)) != []
    limited = rk.SimilarityScope(from_ts=15.0)
    assert _ids(find(limited, postings=postings)) == _ids(find(limited)) == [2, 3]


def test_scores_do_not_depend_on_the_order_of_postings(spark, docs):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(i % 7 + 1))
    some = docs.limit(0).unionByName(docs.where("asset_id = 1").withColumn("description", F.lit(text))).unionByName(docs)
    postings = build_postings(some).coalesce(1)
    weights = {w: 1 + i % 3 for i, w in enumerate(words)}
    scores = [
        rk.bm25_scores(some, weights, True, postings.sortWithinPartitions(order)).first()["score"]
        for order in (F.asc("tf"), F.desc("tf"), F.asc("term"), F.desc("term"))
    ]
    assert len(set(scores)) == 1
