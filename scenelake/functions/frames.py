"""Perceptual-hash distance, sharpness and text similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.schemas import SHARPNESS_FULL_SCALE

# Laplacian kernels for aperture 1 and 3, as (centre, edge, corner) weights.
LAPLACIAN_WEIGHTS = {1: (-4.0, 1.0, 0.0), 3: (-8.0, 0.0, 2.0)}
_LANE_DIGITS = 8


def phash_distance(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two equally long hex hashes, eight digits at a time."""

    def lane(text: Column, at: int) -> Column:
        return F.conv(F.substring(text, at, _LANE_DIGITS), 16, 10).cast("bigint")

    lanes = [
        F.bit_count(lane(a, at).bitwiseXOR(lane(b, at))) for at in range(1, digits + 1, _LANE_DIGITS)
    ]
    total = lanes[0]
    for more in lanes[1:]:
        total = total + more
    return total


def normalised_sharpness(variance: Column, full_scale: float = SHARPNESS_FULL_SCALE) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), variance / F.lit(full_scale)))


def laplacian_variance(grey: np.ndarray, aperture: int = 1) -> float:
    """Variance of the Laplacian of a grey image, mirrored at the border."""
    centre, edge, corner = LAPLACIAN_WEIGHTS[aperture]
    img = np.pad(grey.astype(np.float64), 1, mode="reflect")
    mid = img[1:-1, 1:-1]
    edges = img[:-2, 1:-1] + img[2:, 1:-1] + img[1:-1, :-2] + img[1:-1, 2:]
    corners = img[:-2, :-2] + img[:-2, 2:] + img[2:, :-2] + img[2:, 2:]
    return float((centre * mid + edge * edges + corner * corners).var())


def with_sharpness(frames: DataFrame, aperture: int = 1) -> DataFrame:
    """Add `sharpness` to frames holding raw grey bytes in `grey` with `width` and `height`."""
    schema = frames.drop("grey").schema.add("sharpness", "double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [
                laplacian_variance(np.frombuffer(g, np.uint8).reshape(h, w), aperture)
                for g, w, h in zip(batch["grey"], batch["width"], batch["height"])
            ]
            yield batch.drop(columns="grey").assign(sharpness=values)

    return frames.mapInPandas(score, schema)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of `b`."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_similarity(left: str | None, right: str | None) -> float:
    """Likeness 0-100 of two texts as word sets: shared words against shared plus remaining words."""
    ours, theirs = set((left or "").split()), set((right or "").split())
    if not ours or not theirs:
        return 0.0
    shared, mine, yours = ours & theirs, ours - theirs, theirs - ours
    if shared and not (mine and yours):
        return 100.0
    a, b = " ".join(sorted(mine)), " ".join(sorted(yours))
    base = len(" ".join(sorted(shared)))
    gap = 1 if base else 0
    whole_a, whole_b = base + gap + len(a), base + gap + len(b)

    def likeness(edits: int, length: int) -> float:
        return 100.0 * (1 - edits / length) if length else 100.0

    scores = [likeness(len(a) + len(b) - 2 * common_subsequence(a, b), whole_a + whole_b)]
    if base:
        scores += [likeness(gap + len(a), base + whole_a), likeness(gap + len(b), base + whole_b)]
    return max(scores)


def token_set_ratio(left: Column, right: Column) -> Column:
    """`token_set_similarity` as a column. Only the longest common subsequence of what two word sets don't share
    is left to Python, and only where nothing simpler decides."""
    words = lambda text: F.array_distinct(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    )
    ours, theirs = words(left), words(right)
    joined = lambda found: F.array_join(F.array_sort(found), " ")
    shared, mine, yours = F.array_intersect(ours, theirs), F.array_except(ours, theirs), F.array_except(theirs, ours)
    empty = (F.size(ours) == 0) | (F.size(theirs) == 0)
    held = (F.size(shared) > 0) & ((F.size(mine) == 0) | (F.size(yours) == 0))
    compared = ~empty & ~held

    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else common_subsequence(x, y) for x, y in zip(a, b)], dtype="Int64")

    common.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    run = F.pandas_udf(common, "bigint")(F.when(compared, joined(mine)), F.when(compared, joined(yours)))
    base, a, b = (F.length(joined(x)) for x in (shared, mine, yours))
    gap = F.when(base > 0, 1).otherwise(0)
    whole_a, whole_b = base + gap + a, base + gap + b
    likeness = lambda edits, length: 100.0 * (1 - edits / length)
    best = F.greatest(
        likeness(a + b - 2 * run, whole_a + whole_b),
        F.when(base > 0, likeness(gap + a, base + whole_a)), F.when(base > 0, likeness(gap + b, base + whole_b)),
    )
    return F.when(empty, 0.0).when(held, 100.0).otherwise(best)
