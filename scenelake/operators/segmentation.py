"""Cutting videos into scenes.

A scene opens at a frame and closes at the first later frame that is 30 s away, or differs in more than
51 hash bits and is 3 s away; the closing frame opens the next scene. Where a scene starts therefore
depends on the previous one, all the way back to the first frame. To keep a long video from becoming
one task, time is cut into blocks. From any frame the next start lies within 30 s or is the first frame
after that, so a block needs only a short look-ahead, and only frames near its beginning can be the
first start in it. Each block says where it is left for every way it can be entered; the ways actually
taken are found by pointer doubling over those few rows; then every block cuts its scenes on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.schemas import (
    PHASH_THRESHOLD, SCENE_CEILING_SECONDS, SCENE_DEBOUNCE_SECONDS, SKIPPED_LEADING_FRAMES,
)
from scenelake.session import cut_lineage

BLOCK_SECONDS = 14_400.0
ANCHOR_ID = -1  # frame id of the remembered anchor of a resumed video


@dataclass(frozen=True)
class Rules:
    threshold: int = PHASH_THRESHOLD
    ceiling: float = SCENE_CEILING_SECONDS
    debounce: float = SCENE_DEBOUNCE_SECONDS
    skipped: int = SKIPPED_LEADING_FRAMES

    def closes(self, start: float, anchor: int, pts: float, phash: int) -> str | None:
        """Why a frame ends the scene opened at `start` with hash `anchor`, if it does."""
        elapsed = pts - start
        if elapsed >= self.ceiling:
            return "temporal"
        if elapsed >= self.debounce and (anchor ^ phash).bit_count() > self.threshold:
            return "phash"
        return None


@dataclass
class OpenScene:
    """The scene being watched: its anchor, and the sharpest frame after the leading ones."""

    start: float
    anchor: int
    to_skip: int
    best_pts: float | None = None
    best_sharpness: float = -1.0
    last_pts: float | None = None
    last_sharpness: float = -1.0

    def watch(self, pts: float, sharpness: float) -> None:
        self.last_pts, self.last_sharpness = pts, sharpness
        if self.to_skip > 0:
            self.to_skip -= 1
        elif sharpness > self.best_sharpness:
            self.best_pts, self.best_sharpness = pts, sharpness

    def closed(self, end: float, reason: str) -> tuple | None:
        """(start, end, reason, best frame time, sharpness); a scene without a usable frame is lost
        unless it is the last one, which falls back to its final frame."""
        if self.best_pts is not None:
            return self.start, end, reason, self.best_pts, self.best_sharpness
        if reason == "forced" and self.last_pts is not None:
            return self.start, end, reason, self.last_pts, self.last_sharpness
        return None


def open_at(frame: tuple, rules: Rules) -> OpenScene:
    """Scene opened by a frame (pts, id, hash, sharpness); a remembered anchor is no frame itself."""
    pts, frame_id, phash, sharpness = frame
    scene = OpenScene(pts, phash, rules.skipped)
    if frame_id != ANCHOR_ID:
        scene.watch(pts, sharpness)
    return scene


def _next_start(frames: list[tuple], at: int, rules: Rules) -> int | None:
    start, _, anchor, _ = frames[at]
    for j in range(at + 1, len(frames)):
        if rules.closes(start, anchor, frames[j][0], frames[j][2]):
            return j
    return None


_EXIT_SCHEMA = "asset_id bigint, block bigint, enter_id bigint, exit_pts double, exit_id bigint"
_SCENE_SCHEMA = (
    "asset_id bigint, start_ts double, end_ts double, keep_reason string, best_pts double, "
    "sharpness_score double, anchor_phash string"
)
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_FRAME = ("pts", "frame_id", "phash", "sharpness", "own")
_CONTEXT = ("enter_id", "after_pts", "after_id", "duration_sec")
_ROWS_PER_BATCH = 10_000


@dataclass(frozen=True)
class Block:
    """Frames of one block in time order, the first `own` of them its own, and what is known around it."""

    asset_id: int
    number: int
    frames: list[tuple]
    own: int
    enter_id: int | None = None
    after_pts: float | None = None
    after_id: int | None = None
    duration_sec: float | None = None


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Cut a sorted stream of rows into blocks; one block is held at a time."""
    key, context, frames, own = None, None, [], 0
    for batch in batches:
        for asset_id, block, kind, pts, frame_id, phash, sharpness, is_own, *around in zip(
            *[c.to_pylist() for c in batch.columns]
        ):
            if (asset_id, block) != key:
                if own:
                    yield Block(*key, frames, own, *(context or ()))
                key, context, frames, own = (asset_id, block), None, [], 0
            if kind == 0:
                context = around
            else:
                frames.append((pts, frame_id, int(phash, 16), sharpness))
                own += is_own
    if own:
        yield Block(*key, frames, own, *(context or ()))


def _by_block(frames: DataFrame, context: DataFrame | None, rows_of, schema: str) -> DataFrame:
    """Apply `rows_of(Block)` to every block.

    One shuffle and one sort bring a block's rows together, context first; many blocks then share a
    task's Arrow batches, instead of each paying for a call of its own.
    """
    line = frames.select(
        "asset_id", "block", F.lit(1).alias("kind"), *_FRAME,
        *[F.lit(None).cast("double" if c in ("after_pts", "duration_sec") else "bigint").alias(c) for c in _CONTEXT],
    )
    if context is not None:
        kinds = dict(frames.dtypes)
        line = line.unionByName(context.select(
            "asset_id", "block", F.lit(0).alias("kind"),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in _FRAME], *_CONTEXT,
        ))
    names = [c.split()[0] for c in schema.split(", ")]
    types = [_ARROW[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        out: list[tuple] = []
        for block in _blocks(batches):
            out.extend(rows_of(block))
            if len(out) >= _ROWS_PER_BATCH:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return line.repartition("asset_id", "block").sortWithinPartitions(
        "asset_id", "block", "kind", "pts", "frame_id"
    ).mapInArrow(run, schema)


def _tagged(frames: DataFrame, block_seconds: float, rules: Rules) -> DataFrame:
    """Each frame in its block, and again as look-ahead of the block before when it is near the start."""
    block = F.floor(F.col("pts") / block_seconds).cast("bigint")
    offset = F.col("pts") - block * block_seconds
    places = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")),
        F.when(offset < rules.ceiling, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
    )
    return frames.select("*", F.explode(F.array_compact(places)).alias("p")).select(
        "asset_id", "p.block", "p.own", "frame_id", "pts", "phash", "sharpness"
    )


def _block_ends(frames: DataFrame, block_seconds: float, rules: Rules) -> DataFrame:
    """Per block: its first frame, and the first frame of the video beyond its look-ahead."""
    block = F.floor(F.col("pts") / block_seconds).cast("bigint").alias("block")
    key = F.struct("pts", "frame_id")
    late = F.col("pts") - F.floor(F.col("pts") / block_seconds) * block_seconds >= rules.ceiling
    summary = frames.groupBy("asset_id", block).agg(
        F.min(key).alias("first"), F.min(F.when(late, key)).alias("late")
    )
    w = Window.partitionBy("asset_id").orderBy("block")
    following = F.lead("block").over(w) == F.col("block") + 1
    after = F.when(
        following, F.coalesce(F.lead("late").over(w), F.lead("first", 2).over(w))
    ).otherwise(F.lead("first").over(w))
    return summary.select(
        "asset_id", "block", F.col("first.frame_id").alias("first_id"),
        (F.row_number().over(w) == 1).alias("opening"),
        after["pts"].alias("after_pts"), after["frame_id"].alias("after_id"),
    )


def _exits(block: Block, block_seconds: float, rules: Rules) -> Iterator[tuple]:
    """Where the chain of scene starts leaves the block, for every frame it may enter at."""
    frames, own = block.frames, block.own
    begin = block.number * block_seconds
    entries = [i for i in range(own) if frames[i][0] - begin < rules.ceiling]
    if len(entries) < own:
        entries.append(len(entries))
    following: dict[int, int | None] = {}
    for entry in entries:
        at: int | None = entry
        while at is not None and at < own:
            if at not in following:
                following[at] = _next_start(frames, at, rules)
            at = following[at]
        leave = frames[at][:2] if at is not None else (block.after_pts, block.after_id)
        yield block.asset_id, block.number, frames[entry][1], *leave


def _scenes(block: Block, rules: Rules, final: bool) -> Iterator[tuple]:
    """Scenes that start in a block, from the frame it is entered at (the first one unless told)."""
    frames, own = block.frames, block.own
    entry = 0
    if block.enter_id is not None:
        entry = next(i for i in range(own) if frames[i][1] == block.enter_id)
    scene = open_at(frames[entry], rules)
    for i in range(entry + 1, len(frames)):
        pts, _, phash, sharpness = frames[i]
        reason = rules.closes(scene.start, scene.anchor, pts, phash)
        if reason is None:
            scene.watch(pts, sharpness)
            continue
        done = scene.closed(pts, reason)
        if done:
            yield block.asset_id, *done, None
        if i >= own:
            return
        scene = open_at(frames[i], rules)
    if block.after_pts is not None:
        done = scene.closed(block.after_pts, "temporal")
    elif not final:
        yield block.asset_id, scene.start, None, None, scene.start, -1.0, f"{scene.anchor:064x}"
        return
    elif scene.last_pts is None:
        return
    else:
        done = scene.closed(max(scene.last_pts, block.duration_sec or 0.0), "forced")
    if done:
        yield block.asset_id, *done, None


def _entered(exits: DataFrame, ends: DataFrame, rounds: int, block_seconds: float) -> DataFrame:
    """(asset_id, block, enter_id) on the chain from each video's first frame.

    Doubling: the pointers reach 1, 2, 4, ... blocks ahead, and every round adds the blocks that far
    behind the known ones. All joins are on unique keys of the small exit table.
    """
    exits = cut_lineage(exits)
    hops = exits.where(F.col("exit_id").isNotNull()).select(
        "asset_id", "block", "enter_id",
        F.floor(F.col("exit_pts") / block_seconds).cast("bigint").alias("to_block"),
        F.col("exit_id").alias("to_id"),
    )
    reached = ends.where("opening").select("asset_id", "block", F.col("first_id").alias("enter_id"))
    key = ["asset_id", "block", "enter_id"]
    for _ in range(rounds):
        ahead = reached.join(hops, key).select(
            "asset_id", F.col("to_block").alias("block"), F.col("to_id").alias("enter_id")
        )
        reached = reached.unionByName(ahead).distinct()
        far = hops.select(
            "asset_id", F.col("block").alias("to_block"), F.col("enter_id").alias("to_id"),
            F.col("to_block").alias("far_block"), F.col("to_id").alias("far_id"),
        )
        hops = hops.join(far, ["asset_id", "to_block", "to_id"]).select(
            "asset_id", "block", "enter_id", F.col("far_block").alias("to_block"),
            F.col("far_id").alias("to_id"),
        )
        reached, hops = cut_lineage(reached), cut_lineage(hops)
    return reached


def segment_scenes(
    frames: DataFrame, durations: DataFrame | None = None, states: DataFrame | None = None,
    progress: DataFrame | None = None, final: bool = True, block_seconds: float = BLOCK_SECONDS,
    rules: Rules = Rules(),
) -> DataFrame:
    """Scenes of frames (asset_id, frame_id, pts, phash, sharpness), one row per scene.

    `durations` (asset_id, duration_sec) may extend the last scene. To resume, `progress` (asset_id,
    max_end_ts) discards frames already covered and `states` (asset_id, anchor_phash, scene_start_ts)
    reopens the scene that was being watched. With `final=False` the last scene stays open and comes
    back as a row with `anchor_phash` and no `keep_reason`: the state to keep.
    """
    if block_seconds <= rules.ceiling:
        raise ValueError("a block must be longer than the longest scene")
    frames = frames.select("asset_id", "frame_id", "pts", "phash", "sharpness")
    covered = [
        df.select("asset_id", F.col(c).alias("since"))
        for df, c in ((progress, "max_end_ts"), (states, "scene_start_ts")) if df is not None
    ]
    if covered:
        since = covered[0] if len(covered) == 1 else covered[0].unionByName(covered[1])
        since = since.groupBy("asset_id").agg(F.max("since").alias("since"))
        frames = frames.join(since, "asset_id", "left").where(
            F.col("since").isNull() | (F.col("pts") >= F.col("since"))
        ).drop("since")
    if states is not None:
        anchors = states.select(
            "asset_id", F.lit(ANCHOR_ID).cast("bigint").alias("frame_id"),
            F.col("scene_start_ts").alias("pts"), F.col("anchor_phash").alias("phash"),
            F.lit(-1.0).alias("sharpness"),
        )
        frames = frames.unionByName(anchors.join(frames.select("asset_id").distinct(), "asset_id", "left_semi"))
    number = F.floor(F.col("pts") / block_seconds).cast("bigint")
    spans = frames.groupBy("asset_id").agg((F.max(number) - F.min(number)).alias("span"))
    span = spans.agg(F.max("span")).first()[0] or 0

    def cut(block: Block) -> Iterator[tuple]:
        return _scenes(block, rules, final)

    none = {c: F.lit(None).cast("double" if c == "after_pts" else "bigint") for c in _CONTEXT[:3]}
    if span == 0:
        whole = frames.select("*", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("own"))
        context = None
        if durations is not None:
            context = durations.select(
                "asset_id", F.lit(0).cast("bigint").alias("block"), "duration_sec",
                *[v.alias(c) for c, v in none.items()],
            )
        return _by_block(whole, context, cut, _SCENE_SCHEMA)

    ends = _block_ends(frames, block_seconds, rules)
    tagged = _tagged(frames, block_seconds, rules)
    around = ends.select(
        "asset_id", "block", "after_pts", "after_id", F.lit(None).cast("bigint").alias("enter_id"),
        F.lit(None).cast("double").alias("duration_sec"),
    )
    exits = _by_block(tagged, around, lambda block: _exits(block, block_seconds, rules), _EXIT_SCHEMA)
    entered = _entered(exits, ends, math.ceil(math.log2(span + 1)), block_seconds)
    context = around.drop("enter_id").join(entered, ["asset_id", "block"])
    if durations is not None:
        context = context.drop("duration_sec").join(
            durations.select("asset_id", "duration_sec"), "asset_id", "left"
        )
    # Blocks no scene starts in have no context and are left out.
    wanted = tagged.join(entered.select("asset_id", "block"), ["asset_id", "block"], "left_semi")
    return _by_block(wanted, context, cut, _SCENE_SCHEMA)


def closed_scenes(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("keep_reason").isNotNull()).drop("anchor_phash")


def open_states(segments: DataFrame) -> DataFrame:
    """Rows for the table of open states."""
    return segments.where(F.col("keep_reason").isNull()).select(
        "asset_id", "anchor_phash", F.col("start_ts").alias("scene_start_ts"),
        F.col("best_pts").alias("current_best_pts"),
        F.col("sharpness_score").alias("current_best_sharpness"),
    )


def save_states(states: DataFrame, segments: DataFrame, processed: DataFrame) -> DataFrame:
    """State table after a pass over the `processed` asset ids: replaced where open, removed where done."""
    kept = states.join(processed.select("asset_id").distinct(), "asset_id", "left_anti")
    return kept.unionByName(open_states(segments).select(*states.columns))
