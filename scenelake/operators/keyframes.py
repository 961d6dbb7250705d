"""The most representative frame of each of n equal windows of a video.

It is the medoid: the frame whose summed hash distance to all frames of its window is smallest. As a distance counts
differing bits, the sum over a window is known from how often each bit is set in it. So one grouped sum over the
digits of the hashes takes the place of comparing frames with each other, and a window of any length is 64 rows.

Nearly all windows are short. Those are answered from their frames as they lie side by side, by the same counts; only
longer ones become 64 rows for each frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

#: Frames of a window that are looked at together, some megabytes; longer windows are counted by digit.
FRAMES_AT_ONCE = 1 << 15
_GROUP = ["asset_id", "window"]


def window_of(pts: Column, duration: Column, n: int) -> Column:
    """Number of the window, from 0; what lies at the end or beyond is in the last one."""
    at = F.floor(pts * n / F.nullif(duration, F.lit(0.0)))
    return F.greatest(F.lit(0), F.least(F.coalesce(at, F.lit(0)), F.lit(n - 1))).cast("int")


def keyframes(frames: DataFrame, durations: DataFrame | None = None, n: int = 100, digits: int = 64) -> DataFrame:
    """(asset_id, window, frame_id, pts, frames, distance_sum): a row for each window with a frame.

    `frames` are asset_id, frame_id, pts and phash (hexadecimal, `digits` long); without `durations` (asset_id,
    duration_sec) a video ends with its last frame. Frames without a hash of this length take no part, nor do those
    without a time. Of equal sums the earliest frame is taken, then the one with the smaller id.
    """
    seen = frames.where(
        F.col("asset_id").isNotNull() & F.col("pts").isNotNull() & (F.length("phash") == digits) & F.col("phash").rlike("^[0-9a-fA-F]+$")
    ).select("asset_id", "frame_id", "pts", F.lower("phash").alias("phash"))
    known = durations.select("asset_id", F.col("duration_sec").cast("double").alias("duration")) if durations is not None else None
    if known is None:
        known = seen.groupBy("asset_id").agg(F.max("pts").cast("double").alias("duration"))
    placed = seen.join(known, "asset_id", "left").withColumn("window", window_of(F.col("pts"), F.col("duration"), n)).drop("duration")
    sizes = placed.groupBy(*_GROUP).agg(F.count("*").alias("frames"))
    long = cut_lineage(sizes.where(F.col("frames") > FRAMES_AT_ONCE).select(*_GROUP))
    short = _of_short_windows(placed.join(long, _GROUP, "left_anti"), digits)
    return short.unionByName(_of_long_windows(placed.join(long, _GROUP, "left_semi"), digits))


def _of_short_windows(placed: DataFrame, digits: int) -> DataFrame:
    """Medoids of windows that lie whole in one task, `FRAMES_AT_ONCE` or so at a time."""
    ids = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"{c} {ids.get(c, 'bigint')}" for c in (*_GROUP, "frame_id", "pts", "frames", "distance_sum"))

    def medoids(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """Of rows in order of windows, times and ids, of which `first` are the first of their window."""
        text = rows.column("phash").combine_chunks().cast(pa.binary())
        begin = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
        code = np.frombuffer(text.buffers()[2], np.uint8, len(rows) * digits, begin)
        # Of a hexadecimal digit the low four bits, for letters plus 9.
        value = (code & 15) + 9 * (code > 57)
        bits = np.unpackbits(value.astype(np.uint8)[:, None], axis=1)[:, 4:].reshape(len(rows), digits * 4)
        size = np.diff(np.append(first, len(rows)))
        total = np.empty(len(rows), np.int64)
        for n in np.unique(size):
            # Windows of one length together: how often each bit is set, then what each frame differs by.
            at = (first[size == n][:, None] + np.arange(n)).ravel()
            own = bits[at].reshape(-1, n, digits * 4)
            held = own.sum(1, dtype=np.int64)
            total[at] = (held.sum(1)[:, None] + np.einsum("gnb,gb->gn", own, n - 2 * held)).ravel()
        window = np.repeat(np.arange(len(first)), size)
        best = np.lexsort((np.arange(len(rows)), total, window))[first]
        taken = rows.select([*_GROUP, "frame_id", "pts"]).take(pa.array(best)).combine_chunks()
        columns = [c.combine_chunks() for c in taken.columns] + [pa.array(size), pa.array(total[best])]
        return pa.RecordBatch.from_arrays(columns, names=[*_GROUP, "frame_id", "pts", "frames", "distance_sum"])

    def starts(rows: pa.Table) -> np.ndarray:
        a, w = (rows.column(c).to_numpy() for c in _GROUP)
        return np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            # The last window may go on in the next batch.
            first = starts(rows)
            if first[-1]:
                yield medoids(rows.slice(0, first[-1]), first[:-1])
            left = rows.slice(first[-1])
        if left is not None:
            yield medoids(left, np.zeros(1, np.int64))

    side_by_side = placed.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "pts", "frame_id")
    return side_by_side.select(*_GROUP, "frame_id", "pts", "phash").mapInArrow(run, schema)


def _of_long_windows(placed: DataFrame, digits: int) -> DataFrame:
    """Medoids by one grouped sum over the digits of the hashes, for windows of any length."""
    # The value of a digit, and how often each of its four bits is set in the window.
    value = F.instr(F.lit("0123456789abcdef"), F.col("digit")) - 1
    digit = F.posexplode(F.split(F.substring("phash", 1, digits), "")).alias("at", "digit")
    bits = [F.sum(F.floor(value / (1 << b)).bitwiseAND(1)).alias(f"b{b}") for b in range(4)]
    counted = placed.select(*_GROUP, digit).where("digit <> ''").groupBy(*_GROUP, "at").agg(F.count("*").alias("n"), *bits)
    # What each value of a digit costs against the window: the frames that have the other bit, for each bit.
    cost = F.array(*(
        sum((F.col("n") - F.col(f"b{b}") if v >> b & 1 else F.col(f"b{b}") for b in range(4)), F.lit(0).cast("bigint"))
        for v in range(16)
    ))
    costs = counted.withColumn("cost", cost).groupBy(*_GROUP).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "cost"))), lambda x: x["cost"]).alias("costs"),
        F.max("n").alias("frames"),
    )
    total = F.aggregate(
        F.zip_with(F.split("phash", ""), "costs", lambda d, c: F.get(c, F.instr(F.lit("0123456789abcdef"), d) - 1)),
        F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint")),
    )
    rated = placed.join(costs, _GROUP).select(*_GROUP, "frame_id", "pts", "frames", total.alias("distance_sum"))
    best = F.min(F.struct("distance_sum", "pts", "frame_id", "frames"))
    return rated.groupBy(*_GROUP).agg(best.alias("m")).select(
        *_GROUP, "m.frame_id", "m.pts", "m.frames", "m.distance_sum"
    )
