import random

import pytest

from scenelake.operators import segmentation as seg
from scenelake.streaming.segment import segment_stream

FRAME = "asset_id bigint, frame_id bigint, pts double, phash string, sharpness double"


def _hash(bits):
    return f"{(1 << bits) - 1:064x}"


def _frames(spark, rows):
    """rows: (asset, pts, bits set in the hash, sharpness)"""
    return spark.createDataFrame(
        [(a, i, float(p), _hash(b), float(s)) for i, (a, p, b, s) in enumerate(rows)], FRAME
    )


def _scenes(df):
    rows = seg.closed_scenes(df).orderBy("asset_id", "start_ts").collect()
    return [(r["start_ts"], r["end_ts"], r["keep_reason"], r["best_pts"], r["sharpness_score"]) for r in rows]


def test_equal_frames_make_one_forced_scene(spark):
    frames = _frames(spark, [(1, p, 0, p) for p in range(5)])
    assert _scenes(seg.segment_scenes(frames)) == [(0.0, 4.0, "forced", 4.0, 4.0)]


def test_short_video_falls_back_to_its_last_frame(spark):
    frames = _frames(spark, [(1, 0, 0, 5), (1, 1, 0, 3)])
    assert _scenes(seg.segment_scenes(frames)) == [(0.0, 1.0, "forced", 1.0, 3.0)]


@pytest.mark.parametrize("duration,end", [(8.0, 8.0), (3.0, 4.0)])
def test_duration_extends_but_never_shortens(spark, duration, end):
    frames = _frames(spark, [(1, p, 0, 1) for p in range(5)])
    durations = spark.createDataFrame([(1, duration)], "asset_id bigint, duration_sec double")
    assert _scenes(seg.segment_scenes(frames, durations))[0][1] == end


def test_triggers():
    rules = seg.Rules()
    far = (1 << 52) - 1
    assert rules.closes(0.0, 0, 30.0, 0) == "temporal"
    assert rules.closes(0.0, 0, 30.0, far) == "temporal"
    assert rules.closes(0.0, 0, 2.9, far) is None
    assert rules.closes(0.0, 0, 3.1, far) == "phash"
    assert rules.closes(0.0, 0, 3.1, far >> 1) is None


def test_scene_without_usable_frame_is_lost(spark):
    frames = _frames(spark, [(1, 0, 0, 9), (1, 4, 60, 1), (1, 5, 60, 2), (1, 6, 60, 3), (1, 7, 60, 3)])
    assert _scenes(seg.segment_scenes(frames)) == [(4.0, 7.0, "forced", 6.0, 3.0)]


def test_no_frames(spark):
    assert _scenes(seg.segment_scenes(_frames(spark, []))) == []


def _random_rows(seed, videos=4, gaps=True):
    rng = random.Random(seed)
    rows = []
    for video in range(1, videos + 1):
        pts, bits = rng.uniform(0, 50), 0
        for _ in range(rng.randint(1, 300)):
            pts += rng.choice([0.25, 1, 1, 2]) if rng.random() > 0.02 or not gaps else rng.uniform(25, 300)
            if rng.random() < 0.15:
                bits = rng.choice([0, 30, 60, 120, 200])
            rows.append((video, round(pts, 3), bits, rng.randint(0, 50)))
    return rows


def _naive(rows):
    """The definition, one video after the other."""
    out, rules = [], seg.Rules()
    for video in sorted({r[0] for r in rows}):
        frames = [(p, int(_hash(b), 16), float(s)) for v, p, b, s in rows if v == video]
        at = 0
        while at is not None:
            start, anchor, _ = frames[at]
            nxt, reason = None, "forced"
            for j in range(at + 1, len(frames)):
                reason = rules.closes(start, anchor, frames[j][0], frames[j][1])
                if reason:
                    nxt = j
                    break
            reason = reason or "forced"
            inside = frames[at:nxt][rules.skipped:]
            end = frames[nxt][0] if nxt is not None else frames[-1][0]
            if inside:
                best = max(inside, key=lambda f: f[2])
                out.append((start, end, reason, best[0], best[2]))
            elif nxt is None:
                out.append((start, end, "forced", frames[-1][0], frames[-1][2]))
            at = nxt
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_of_any_length_give_the_same_scenes(spark, seed):
    rows = _random_rows(seed)
    frames = _frames(spark, rows)
    expected = _naive(rows)
    for block in (31.0, 100.0, 14_400.0):
        assert sorted(_scenes(seg.segment_scenes(frames, block_seconds=block))) == expected


@pytest.mark.parametrize("block", [40.0, 14_400.0])
def test_resume_continues_where_it_stopped(spark, block):
    rows = _random_rows(9)
    frames = _frames(spark, rows)
    early = seg.segment_scenes(frames.where("pts < 120"), final=False, block_seconds=block)
    closed = seg.closed_scenes(early)
    progress = closed.groupBy("asset_id").agg({"end_ts": "max"}).toDF("asset_id", "max_end_ts")
    late = seg.segment_scenes(frames, states=seg.open_states(early), progress=progress, block_seconds=block)
    assert sorted(_scenes(early) + _scenes(late)) == _naive(rows)


def test_states_are_replaced_and_removed(spark):
    schema = "asset_id bigint, anchor_phash string, scene_start_ts double, current_best_pts double, current_best_sharpness double"
    old = spark.createDataFrame([(1, "x", 0.0, 0.0, -1.0), (2, "y", 0.0, 0.0, -1.0), (3, "z", 0.0, 0.0, -1.0)], schema)
    frames = _frames(spark, [(1, p, 0, 1) for p in range(4)])
    processed = spark.createDataFrame([(1,), (2,)], "asset_id bigint")
    new = seg.save_states(old, seg.segment_scenes(frames, final=False), processed)
    got = {r["asset_id"]: r["anchor_phash"] for r in new.collect()}
    assert got == {1: _hash(0), 3: "z"}


def test_stream_equals_batch(spark, tmp_path):
    rows = _random_rows(5, gaps=False)
    source = tmp_path / "in"
    plain = _frames(spark, rows)
    from pyspark.sql import functions as F

    marked = plain.withColumn("last", F.lit(False)).withColumn("duration_sec", F.lit(None).cast("double"))
    ends = spark.createDataFrame(
        [(v, 10**6, 0.0, _hash(0), 0.0, True, None) for v in {r[0] for r in rows}], marked.schema
    )
    parts = [marked.where("pts < 60"), marked.where("pts >= 60 and pts < 130"), marked.where("pts >= 130").unionByName(ends)]
    query = None
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(marked.schema).parquet(str(source))
        query = (
            segment_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r["start_ts"], r["end_ts"], r["keep_reason"], r["best_pts"], r["sharpness_score"]) for r in out.collect())
    assert got == _naive(rows)
