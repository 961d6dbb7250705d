"""State log, keyframes, moved files and duplicate groups."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from scenelake.operators import changes as ch
from scenelake.operators import files
from scenelake.operators import keyframes as kf
from scenelake.operators import state_log as sl
from scenelake.operators.keyframes import keyframes
from scenelake.schemas import ASSET


def assets(spark, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in ASSET.fields} for r in rows], ASSET)


def stamps(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_log_equals_rewriting_and_leaves_other_ranges(spark, tmp_path):
    rows = [
        {"id": i, "library_id": "ab"[i % 2], "rel_path": f"{i}.jpg", "type": "image", "status": ("pending", "poisoned")[i % 3 == 0],
         "retry_count": i % 7, "error_message": "x" if i % 3 == 0 else None} for i in range(40)
    ]
    wide = assets(spark, rows)
    base, log = str(tmp_path / "base"), str(tmp_path / "log")
    sl.write_base(wide, base, span=10)
    read = lambda: (sl.read_base(spark, base), sl.read_log(spark, log))
    shown = lambda df: sorted((r["id"], r["rel_path"], r["status"], r["retry_count"], r["error_message"]) for r in df.collect())
    reset = lambda df: ch.reset_poisoned(df, "a")
    done = spark.createDataFrame([(12, "failed", "boom"), (14, "completed", None), (999, "failed", "none")], "id long, status string, error_message string")
    assert shown(sl.snapshot(*read())) == shown(wide)
    before = stamps(base)
    for _ in range(2):  # the same version again changes nothing
        sl.append(*read(), reset, log, 1)
    assert stamps(base) == before
    log_rows = sl.read_log(spark, log)
    assert {r["id"] for r in log_rows.collect()} == {i for i in range(40) if i % 6 == 0}
    sl.append(*read(), lambda df: ch.apply_status(df, done), log, 2)
    want = shown(ch.apply_status(reset(wide), done))
    assert shown(sl.snapshot(*read())) == want
    # Only the range of 12 and 14 is touched by this log.
    sl.compact(spark, base, sl.read_log(spark, log).where("version = 2"), span=10)
    after = stamps(base)
    assert {p for p, t in before.items() if after.get(p) == t} == {p for p in before if "part=1/" not in p}
    # Nothing is applied twice, neither by reading nor by compacting again.
    assert shown(sl.snapshot(*read())) == shown(sl.snapshot(sl.read_base(spark, base), sl.read_log(spark, log)))
    sl.compact(spark, base, sl.read_log(spark, log), span=10)
    sl.compact(spark, base, sl.read_log(spark, log), span=10)
    assert shown(sl.read_base(spark, base).select(wide.columns)) == [
        r if r[0] not in (12, 14) else w for r, w in zip(want, want)
    ]


def test_log_of_enrichment(spark, tmp_path):
    wide = assets(spark, [{"id": i, "library_id": "a", "rel_path": f"{i}", "type": "image", "status": "completed"} for i in range(4)])
    found = spark.createDataFrame([(2, "red car", ["car"], None, "m", "1")], "id long, description string, tags array<string>, ocr_text string, model_name string, model_version string")
    base, log = str(tmp_path / "base"), str(tmp_path / "log")
    sl.write_base(wide, base)
    sl.append(sl.read_base(spark, base), None, lambda df: ch.save_analysis(df, found), log, 1, sl.ENRICHMENT)
    now = sl.snapshot(sl.read_base(spark, base), sl.read_log(spark, log), sl.ENRICHMENT)
    assert {r["id"]: r["visual_analysis"] and r["visual_analysis"]["description"] for r in now.collect()} == {0: None, 1: None, 2: "red car", 3: None}


def test_keyframes_are_medoids(spark, monkeypatch):
    rng = random.Random(2)
    rows, frame = [], 0
    for video in range(4):
        for _ in range(rng.choice([1, 7, 40])):
            frame += 1
            rows.append((video, frame, rng.choice([None, rng.uniform(-1, 50.0)]) if frame % 9 == 0 else rng.uniform(0, 50.0), "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(4))))
    rows += [(9, 1000, 1.0, None), (9, 1001, 1.0, "zzzz"), (9, 1002, 1.0, "ab"), (8, 2000, 0.0, "ffff"), (8, 2001, 0.0, "ffff")]
    df = spark.createDataFrame(rows, "asset_id long, frame_id long, pts double, phash string").repartition(3)
    durations = spark.createDataFrame([(i, 40.0) for i in range(4)], "asset_id long, duration_sec double")
    want = {}
    for video, frame, pts, h in rows:
        if pts is None or h is None or len(h) != 4 or not all(c in "0123456789abcdefABCDEF" for c in h):
            continue
        length = 40.0 if video < 4 else 0.0
        window = max(0, min(int(pts * 5 // length) if length else 0, 4))
        want.setdefault((video, window), []).append((pts, frame, int(h, 16)))
    got = {(r["asset_id"], r["window"]): r for r in keyframes(df, durations, n=5, digits=4).collect()}
    assert set(got) == set(want)
    for key, members in want.items():
        sums = sorted((sum((h ^ o).bit_count() for _, _, o in members), pts, frame) for pts, frame, h in members)
        r = got[key]
        assert (r["distance_sum"], r["pts"], r["frame_id"], r["frames"]) == (*sums[0], len(members))
    assert keyframes(df.where("false")).count() == 0
    # Windows of any length give the same by digit, and short ones are never made a row per digit.
    for at_once in (0, 7, 20):
        with monkeypatch.context() as m:
            m.setattr(kf, "FRAMES_AT_ONCE", at_once)
            assert sorted(keyframes(df, durations, n=5, digits=4).collect()) == sorted(got.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    assert sorted(keyframes(df, durations, n=5, digits=4).collect()) == sorted(got.values())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    short = kf._of_short_windows(df.withColumn("window", F.lit(0)).where("length(phash) = 4"), 4)
    assert "Generate" not in short._jdf.queryExecution().executedPlan().toString()


PLACE = "library_id string, rel_path string, digest string"


def test_moves_copies_and_unreachable_roots(spark):
    known = spark.createDataFrame([
        (1, "a", "old/1", "d1"), (2, "a", "old/2", "d2"), (3, "b", "old/3", "d2"), (4, "a", "stays", "d4"), (5, "gone", "x", "d5"),
        (6, "a", "lost", "d6"), (7, "a", "nodigest", None), (8, "b", "old/8", "d1"), (9, "a", "old/9", "d9"),
    ], f"asset_id long, {PLACE}")
    found = spark.createDataFrame([
        ("a", "new/1", "d1"), ("b", "new/2", "d2"), ("a", "stays", "d4"), ("a", "copy of stays", "d4"), ("a", "new/5", "d5"),
        ("a", "fresh", "d7"), ("a", "also no digest", None), ("b", "n9", "d9"), ("b", "o9", "d9"), ("a", "fresh", "d7"),
    ], PLACE)
    away = spark.createDataFrame([("gone",)], "library_id string")
    rows = files.match_moves(known, found, away).collect()
    by = lambda change: {(r["asset_id"], r["rel_path"]) for r in rows if r["change"] == change}
    # Within a library first: asset 1, not 8, takes new/1, and 3, not 2, takes new/2.
    assert {(1, "new/1"), (3, "new/2")} <= by("moved") and len(by("moved")) == 3
    assert {(a, p[-2:]) for a, p in by("moved") if a == 9} <= {(9, "n9"), (9, "o9")}
    assert {p for _, p in by("copy")} == {"copy of stays", *({"n9", "o9"} - {p for _, p in by("moved")})}
    assert {p for _, p in by("new")} == {"new/5", "fresh", "also no digest"}
    assert {a for a, _ in by("missing")} == {2, 6, 7, 8}
    # Asset 5 lies below a root that could not be looked at: it is neither moved nor missing.
    assert 5 not in {r["asset_id"] for r in rows}
    moved = files.apply_moves(assets(spark, [{"id": 1, "library_id": "a", "rel_path": "old/1"}, {"id": 4, "library_id": "a", "rel_path": "stays"}]), files.match_moves(known, found, away))
    assert {r["id"]: r["rel_path"] for r in moved.collect()} == {1: "new/1", 4: "stays"}
    assert files.match_moves(known.where("false"), found.where("false")).count() == 0


def test_many_files_with_one_content(spark):
    known = spark.range(300).select(F.col("id").alias("asset_id"), F.lit("a").alias("library_id"), F.concat(F.lit("o"), "id").alias("rel_path"), F.lit("d").alias("digest"))
    found = spark.range(200).select(F.lit("b").alias("library_id"), F.concat(F.lit("n"), "id").alias("rel_path"), F.lit("d").alias("digest"))
    rows = files.match_moves(known, found).collect()
    moved = [r for r in rows if r["change"] == "moved"]
    assert len(moved) == len({r["rel_path"] for r in moved}) == len({r["asset_id"] for r in moved}) == 200
    assert {r["asset_id"] for r in rows if r["change"] == "missing"} == set(range(200, 300))


def test_digests_of_files(spark, tmp_path):
    data = {"a": b"", "b": b"x" * 3_000_000, "c d/é": b"x" * 3_000_000}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    df = spark.createDataFrame([*((n,) for n in data), ("none",), (None,)], "path string").withColumn("digest0", F.lit(1))
    got = {r["path"]: r["digest"] for r in files.content_digests(df, str(tmp_path)).collect()}
    assert got == {**{n: hashlib.sha256(v).hexdigest() for n, v in data.items()}, "none": None, None: None}


@pytest.mark.parametrize("change", [
    [(2, None, True), (9, "x", True)], [(1, "y", True), (3, "x", False)], [(4, "x", True)], [],
])
def test_groups_after_changes(spark, change):
    schema = "asset_id long, digest string, reachable boolean"
    members = spark.createDataFrame([(1, "x", False), (2, "x", True), (3, "x", True), (4, "y", True), (5, None, True), (6, "z", None)], schema)
    changes = spark.createDataFrame(change, schema)
    groups, now = files.regroup(files.duplicate_groups(members), members, changes)
    assert sorted(tuple(r) for r in groups.collect()) == sorted(tuple(r) for r in files.duplicate_groups(now).collect())
    first = {r["digest"]: (r["representative"], r["copies"], r["reachable"]) for r in files.duplicate_groups(members).collect()}
    assert first == {"x": (2, 3, 2), "y": (4, 1, 1), "z": (6, 1, 0)}


def test_stable_files_one_by_one_and_at_once(spark):
    rng = random.Random(6)
    rows = []
    for scan, at in enumerate([0.0, 30.0, 60.0, 61.0, 130.0, 200.0]):
        for name in "abcdef":
            if rng.random() < 0.8:
                rows.append((scan, "l", name, rng.choice([1, 1, 1, 2, None]), rng.choice([5.0, 5.0, None]) if name == "f" else 5.0, at))
    rows.append((2, "l", "a", 9, 5.0, 59.0))  # an older row of the same scan
    scans = spark.createDataFrame(rows, "n int, library_id string, rel_path string, size long, mtime double, seen_at double")
    state = spark.createDataFrame([], files.STABLE)
    plain = {}
    for scan in range(6):
        one = scans.where(f"n = {scan}").drop("n")
        state = files.observe(state, one)
        if scan == 3:
            # Twice, and one that comes late.
            state = files.observe(files.observe(state, one), scans.where("n = 1").drop("n"))
        state = spark.createDataFrame(state.collect(), files.STABLE)
        latest = {}
        for n, _, name, size, mtime, at in rows:
            if n == scan and (name not in latest or at > latest[name][2]):
                latest[name] = (size, mtime, at)
        for name, (size, mtime, at) in latest.items():
            old = plain.get(name)
            if old is None or old[:2] != (size, mtime):
                plain[name] = (size, mtime, at, at, None)
            else:
                plain[name] = (*old[:3], at, old[4] if old[4] is not None else at if at - old[2] >= 60 else None)
    got = {r["rel_path"]: tuple(r)[2:] for r in state.collect()}
    assert got == plain and any(v[4] is not None for v in got.values()) and any(v[4] is None for v in got.values())
    whole = scans.drop("n").where("not (size <=> 9)")
    assert {r["rel_path"]: tuple(r)[2:] for r in files.stable_files(whole).collect()} == plain
    assert files.stable_files(scans.where("false")).count() == 0


def test_steps_of_a_match_are_not_computed_again(spark):
    known = spark.range(40).selectExpr("id as asset_id", "'l' || id % 3 as library_id", "'old/' || id as rel_path", "'d' || id % 5 as digest")
    found = spark.range(45).selectExpr("'l' || id % 2 as library_id", "'new/' || id as rel_path", "'d' || id % 4 as digest")
    changes = files.match_moves(known, found)
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4
    assert changes.where("change = 'moved'").count() == 32 and changes.where("change = 'missing'").count() == 8
    assert changes.where("change in ('copy', 'new')").count() == 13
