"""Scene segmentation of frames as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scenelake.operators.segmentation import OpenScene, Rules

_OUTPUT = (
    "asset_id bigint, start_ts double, end_ts double, keep_reason string, best_pts double, "
    "sharpness_score double"
)
_STATE = (
    "start double, anchor string, to_skip int, best_pts double, best_sharpness double, "
    "last_pts double, last_sharpness double"
)


class SceneProcessor(StatefulProcessor):
    """One open scene per video, kept in the state store between batches.

    A row with `last` set ends its video: the open scene is closed at the later of the last frame and
    `duration_sec`, and the state is dropped. Frames before the last one seen are late and ignored. A
    video's frames of one batch are sorted together, so the source's limit per trigger bounds memory.
    """

    def __init__(self, rules: Rules = Rules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open_scene", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scene = self._load()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["last", "pts", "frame_id"])
        out: list[tuple] = []
        ended = False
        for row in batch.itertuples(index=False):
            if row.last:
                scene, ended = self._finish(scene, row, out), True
                continue
            scene = self._advance(scene, row, out)
        if scene is not None:
            self.open.update((
                scene.start, f"{scene.anchor:064x}", scene.to_skip, scene.best_pts,
                scene.best_sharpness, scene.last_pts, scene.last_sharpness,
            ))
        elif ended:
            self.open.clear()
        if out:
            columns = [c.split()[0] for c in _OUTPUT.split(", ")]
            yield pd.DataFrame([(key[0], *scene_row) for scene_row in out], columns=columns)

    def close(self) -> None:
        pass

    def _load(self) -> OpenScene | None:
        if not self.open.exists():
            return None
        start, anchor, to_skip, best_pts, best_sharpness, last_pts, last_sharpness = self.open.get()
        return OpenScene(start, int(anchor, 16), to_skip, best_pts, best_sharpness, last_pts, last_sharpness)

    def _advance(self, scene: OpenScene | None, row, out: list[tuple]) -> OpenScene:
        phash = int(row.phash, 16)
        if scene is not None and scene.last_pts is not None and row.pts < scene.last_pts:
            return scene
        if scene is not None:
            reason = self.rules.closes(scene.start, scene.anchor, row.pts, phash)
            if reason is not None:
                done = scene.closed(row.pts, reason)
                if done:
                    out.append(done)
                scene = None
        if scene is None:
            scene = OpenScene(row.pts, phash, self.rules.skipped)
        scene.watch(row.pts, row.sharpness)
        return scene

    def _finish(self, scene: OpenScene | None, row, out: list[tuple]) -> None:
        if scene is None or scene.last_pts is None:
            return None
        end = scene.last_pts if pd.isna(row.duration_sec) else max(scene.last_pts, row.duration_sec)
        done = scene.closed(end, "forced")
        if done:
            out.append(done)
        return None


def segment_stream(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Closed scenes of a stream of (asset_id, frame_id, pts, phash, sharpness, last, duration_sec)."""
    return frames.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=SceneProcessor(rules), outputStructType=_OUTPUT, outputMode="Append",
        timeMode="None",
    )
