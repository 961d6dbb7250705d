"""Image analysis of scenes: what needs it, running it, and writing the results back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.frames import token_set_ratio
from scenelake.operators.ordered import previous_value
from scenelake.schemas import SEMANTIC_DUPLICATE_RATIO

Analyzer = Callable[[bytes, str], tuple[str, list[str], "str | None"]]
_ANALYSIS = "description string, tags array<string>, ocr_text string, model_name string, model_version string"


def needs_ocr() -> Column:
    """No analysis yet, or one whose text pass has not run (whether or not it would find any)."""
    return ~F.coalesce(F.col("metadata.analysis.ocr_done"), F.lit(False))


def scenes_needing_ocr(scene: DataFrame) -> DataFrame:
    return scene.where(F.col("description").isNotNull() & needs_ocr())


def vision_worklist(scene: DataFrame, asset: DataFrame, model_id: int, mode: str) -> DataFrame:
    """Scenes a pass has to analyse, and whether another model's results must be replaced.

    `light` takes scenes without description, `full` those with one that lack the text pass.
    """
    todo = {"light": F.col("description").isNull(), "full": F.col("description").isNotNull() & needs_ocr()}
    differs = [
        F.coalesce(F.col(c) != model_id, F.lit(False)) for c in ("analysis_model_id", "tags_model_id")
    ]
    owner = asset.select(F.col("id").alias("asset_id"), (differs[0] | differs[1]).alias("model_mismatch"))
    return scene.where(todo[mode]).join(owner, "asset_id").withColumn(
        "mode", F.when(F.col("model_mismatch"), "light").otherwise(mode)
    )


def semantic_duplicates(
    scene: DataFrame, ratio: float = SEMANTIC_DUPLICATE_RATIO, chunk_seconds: float = 3600.0
) -> DataFrame:
    """Flag scenes whose description is nearly that of the scene before them."""
    paired = previous_value(
        scene, ["asset_id"], F.col("start_ts"), [F.col("start_ts"), F.col("id")], F.col("description"),
        "previous", chunk_seconds,
    )
    comparable = (F.length("previous") > 0) & (F.length("description") > 0)
    # Equal descriptions need no comparison in Python.
    score = F.when(F.col("previous") == F.col("description"), 100.0).otherwise(
        token_set_ratio(F.col("previous"), F.col("description"))
    )
    return paired.withColumn("similarity", F.when(comparable, score)).withColumn(
        "semantic_duplicate", F.coalesce(F.col("similarity") > ratio, F.lit(False))
    ).drop("previous")


def mark_semantic_duplicates(
    scene: DataFrame, ratio: float = SEMANTIC_DUPLICATE_RATIO, chunk_seconds: float = 3600.0
) -> DataFrame:
    """Scenes with the flag in their metadata; scenes without metadata stay without."""
    flagged = semantic_duplicates(scene, ratio, chunk_seconds)
    return flagged.withColumn(
        "metadata",
        F.when(F.col("metadata").isNotNull(), F.col("metadata").withField("semantic_duplicate", F.col("semantic_duplicate"))),
    ).select(*scene.columns)


def _with_analysis(scene: DataFrame, values: dict[str, Column]) -> Column:
    kind = scene.schema["metadata"].dataType
    old = F.col("metadata")
    analysis = F.struct(
        *[
            values.get(f.name, old["analysis"][f.name]).cast(f.dataType).alias(f.name)
            for f in kind["analysis"].dataType.fields
        ]
    )
    return F.struct(
        *[(analysis if n == "analysis" else old[n]).alias(n) for n in kind.names]
    )


def write_scene_analysis(scene: DataFrame, results: DataFrame) -> DataFrame:
    """Write results (id, mode, description, tags, ocr_text) into scenes.

    `light` sets all three and leaves other metadata alone; `full` sets the text only.
    """
    names = ("mode", "description", "tags", "ocr_text")
    new = results.select("id", *[F.col(n).alias("n_" + n) for n in names])
    joined = scene.join(new, "id", "left")
    done = F.lit(True)
    light = _with_analysis(scene, {
        "description": F.col("n_description"), "tags": F.col("n_tags"), "ocr_text": F.col("n_ocr_text"),
        "ocr_done": done,
    })
    full = _with_analysis(scene, {"ocr_text": F.col("n_ocr_text"), "ocr_done": done})
    mode = F.col("n_mode")
    metadata = F.when(mode == "light", light).when(mode == "full", full).otherwise(F.col("metadata"))
    text = (
        F.when(mode == "light", F.coalesce("n_description", F.lit("")))
        .when(mode == "full", F.coalesce("description", F.lit(""))).otherwise(F.col("description"))
    )
    rules = {"metadata": metadata, "description": text}
    return joined.select(*[rules.get(c, F.col(c)).alias(c) for c in scene.columns])


def completable_videos(scene: DataFrame) -> DataFrame:
    """Videos all of whose scenes are described and read."""
    complete = F.col("description").isNotNull() & ((F.length("description") == 0) | ~needs_ocr())
    return scene.groupBy("asset_id").agg(F.bool_and(complete).alias("ok")).where("ok").select("asset_id")


def mock_analyzer(image: bytes, mode: str) -> tuple[str, list[str], str | None]:
    """Stand-in for a model."""
    return "A placeholder description.", ["mock", "test"], "MOCK TEXT"


ANALYZERS: dict[str, tuple[Analyzer, str, str]] = {"mock": (mock_analyzer, "mock-analyzer", "1.0")}


def register_analyzer(name: str, analyze: Analyzer, model_name: str, model_version: str) -> None:
    """Make a model available under a name; it must be picklable."""
    ANALYZERS[name] = (analyze, model_name, model_version)


def analyze_images(images: DataFrame, analyzer: str = "mock", mode: str = "full") -> DataFrame:
    """Run an analyser over (id, image); `mode` tells it whether to read text too."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyser {analyzer!r}")
    analyze, model, version = ANALYZERS[analyzer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [analyze(image, mode) for image in batch["image"]]
            yield pd.DataFrame({
                "id": batch["id"],
                "description": [d for d, _, _ in found],
                "tags": [t for _, t, _ in found],
                "ocr_text": [o for _, _, o in found],
                "model_name": model,
                "model_version": version,
            })

    return images.select("id", "image").mapInPandas(run, f"id bigint, {_ANALYSIS}")
