"""Which files of a scan are moved, copied or new, and which assets show the same content.

Content is told apart by a digest. Files are matched one to one, so two assets never claim one file.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.ordered import previous_value, row_numbers, running
from scenelake.session import cut_lineage

_PART = 1 << 20
# Paths of one digest are numbered in so many ranges of their hash.
_RANGES = 1 << 12


def _digest(path: str) -> str | None:
    """Digest of a file's content, read in parts; none if it can't be read."""
    found = hashlib.sha256()
    try:
        if "://" in path:
            fs, name = pa.fs.FileSystem.from_uri(path)
            source = fs.open_input_stream(name)
        else:
            source = open(os.fspath(path), "rb")  # noqa: SIM115
        with source:
            while part := source.read(_PART):
                found.update(part)
    except OSError:
        return None
    return found.hexdigest()


def content_digests(files: DataFrame, root: str) -> DataFrame:
    """`files` with `digest` of the file at `root` + path; null where it can't be read. Memory doesn't grow with a file.
    Without a scheme the root must be a path that every executor sees."""
    base, names = root.rstrip("/"), list(files.columns)
    at = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if p is None else _digest(f"{base}/{p}") for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=[*names, "digest"])

    # Reading takes long, rows are short: one task for a few files.
    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return spread.mapInArrow(run, f"{schema}, digest string")


def _numbered_paths(found: DataFrame, keys: list[str]) -> DataFrame:
    """Files of a group numbered in order of a hash of their place, then of the place itself."""
    hashed = found.withColumn("_h", F.xxhash64("library_id", "rel_path"))
    order = [F.col("_h"), F.col("library_id"), F.col("rel_path")]
    return running(hashed, keys, F.col("_h"), order, F.lit(1).cast("bigint"), "_n", 2.0**64 / _RANGES).drop("_h")


def match_moves(known: DataFrame, found: DataFrame, unreachable: DataFrame | None = None) -> DataFrame:
    """(change, asset_id, library_id, rel_path, old_library_id, old_rel_path) of a scan against known assets.

    `known`: asset_id, library_id, rel_path, digest. `found`: library_id, rel_path, digest of all files seen.
    `unreachable`: library_id of roots that could not be looked at; what lies there is never taken for gone.

    An asset whose file is gone and a new file with its digest make a `moved`; of several, within one library first,
    assets by id and files by a hash of their place, each once. Other new files are a `copy` if an asset that is still
    there, or the target of a move, has the digest, else `new`. Assets that are gone without a match are `missing`. A
    null digest matches nothing. Rows that repeat a place are one. Each step goes on from the stored rows of the one before,
    so none is computed again by those that follow.
    """
    place = ["library_id", "rel_path"]
    known, found = known.dropDuplicates(["asset_id"]), found.dropDuplicates(place)
    new = found.join(known.select(place), place, "left_anti")
    gone = known.join(found.select(place), place, "left_anti")
    if unreachable is not None:
        gone = gone.join(unreachable.select("library_id").distinct(), "library_id", "left_anti")
    new, gone = cut_lineage(new), cut_lineage(gone)

    def pairs(gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        left = row_numbers(gone.where("digest is not null"), keys, "asset_id", "_n").select(
            *keys, "_n", "asset_id", F.col("library_id").alias("old_library_id"), F.col("rel_path").alias("old_rel_path")
        )
        right = _numbered_paths(new.where("digest is not null"), keys).select(
            *keys, "_n", F.struct("library_id", "rel_path").alias("to")
        )
        return left.join(right, [*keys, "_n"]).select(
            "asset_id", "to.library_id", "to.rel_path", "old_library_id", "old_rel_path"
        )

    near = cut_lineage(pairs(gone, new, ["digest", "library_id"]))
    rest_gone = cut_lineage(gone.join(near.select("asset_id"), "asset_id", "left_anti"))
    rest_new = cut_lineage(new.join(near.select(place), place, "left_anti"))
    moved = near.unionByName(cut_lineage(pairs(rest_gone, rest_new, ["digest"])))
    left_new = cut_lineage(new.join(moved.select(place), place, "left_anti"))
    left_gone = gone.join(moved.select("asset_id"), "asset_id", "left_anti")
    # Content that is somewhere: at a place where it was, or at one that a move leads to.
    there = found.join(left_new.select(place), place, "left_anti").select("digest").where("digest is not null").distinct()
    fresh = left_new.join(there.withColumn("_held", F.lit(True)), "digest", "left")
    nothing: dict[str, Column] = {c: F.lit(None).cast("string") for c in ("old_library_id", "old_rel_path")}
    columns = ["change", "asset_id", *place, "old_library_id", "old_rel_path"]
    return (
        moved.withColumn("change", F.lit("moved")).select(columns)
        .unionByName(fresh.withColumns({
            "change": F.when(F.col("_held"), "copy").otherwise("new"), "asset_id": F.lit(None).cast("bigint"), **nothing,
        }).select(columns))
        .unionByName(left_gone.withColumns({
            "change": F.lit("missing"), "old_library_id": F.col("library_id"), "old_rel_path": F.col("rel_path"),
            "library_id": F.lit(None).cast("string"), "rel_path": F.lit(None).cast("string"),
        }).select(columns))
    )


def apply_moves(asset: DataFrame, changes: DataFrame) -> DataFrame:
    """Assets at the places they have moved to; everything else stays."""
    to = changes.where("change = 'moved'").select("asset_id", F.struct("library_id", "rel_path").alias("_to"))
    rows = asset.join(to.withColumnRenamed("asset_id", "id"), "id", "left")
    new = {c: F.coalesce(F.col("_to")[c], F.col(c)).alias(c) for c in ("library_id", "rel_path")}
    return rows.select(*(new.get(c, F.col(c)) for c in asset.columns))


def duplicate_groups(members: DataFrame) -> DataFrame:
    """(digest, representative, copies, reachable) of members (asset_id, digest, reachable).

    The representative is the smallest id among reachable members, or of all if none is. Members are counted before
    any shuffle, so content that very many share is no hot group. A null digest is no group.
    """
    best = F.min(F.struct((~F.coalesce("reachable", F.lit(False))).alias("away"), "asset_id"))
    groups = members.where("digest is not null").groupBy("digest").agg(
        best.alias("m"), F.count("*").alias("copies"), F.count_if(F.coalesce("reachable", F.lit(False))).alias("reachable")
    )
    return groups.select("digest", F.col("m.asset_id").alias("representative"), "copies", "reachable")


def regroup(groups: DataFrame, members: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members after `changes` (asset_id, digest, reachable): rows of new or changed assets, with a null digest
    for those that are gone. Only groups that an asset leaves, joins or changes in are computed again."""
    left = members.join(changes.select("asset_id"), "asset_id", "left_semi").select("digest")
    touched = left.unionByName(changes.select("digest")).where("digest is not null").distinct()
    now = members.join(changes.select("asset_id"), "asset_id", "left_anti").unionByName(
        changes.where("digest is not null").select(members.columns)
    )
    again = duplicate_groups(now.join(touched, "digest", "left_semi"))
    return groups.join(touched, "digest", "left_anti").unionByName(again), now


STABLE = "library_id string, rel_path string, size bigint, mtime double, since double, last_seen double, stable_at double"
HOLD_SECONDS = 60.0
_SPAN_SECONDS = 86_400.0


def observe(state: DataFrame, scan: DataFrame, hold: float = HOLD_SECONDS) -> DataFrame:
    """State of files (`STABLE`) after one more scan (library_id, rel_path, size, mtime, seen_at).

    A file is stable (`stable_at`) from the first scan at which size and time have held for `hold` seconds; any
    change begins anew. Of several rows of a file in a scan the latest counts; what isn't newer than what was seen
    already changes nothing, so a scan may come late or twice. Files that a scan doesn't show keep their state.
    """
    place = ["library_id", "rel_path"]
    last = F.max_by(F.struct("size", "mtime", "seen_at"), F.struct("seen_at", "size", "mtime"))
    new = scan.where("seen_at is not null").groupBy(*place).agg(last.alias("n"))
    rows = state.join(new, place, "full")
    fresh = F.col("n.seen_at").isNotNull() & (F.col("last_seen").isNull() | (F.col("n.seen_at") > F.col("last_seen")))
    same = F.col("since").isNotNull() & F.col("size").eqNullSafe(F.col("n.size")) & F.col("mtime").eqNullSafe(F.col("n.mtime"))
    held = F.when(F.col("n.seen_at") - F.col("since") >= hold, F.col("n.seen_at"))
    values = {
        "size": F.when(fresh, F.col("n.size")).otherwise(F.col("size")),
        "mtime": F.when(fresh, F.col("n.mtime")).otherwise(F.col("mtime")),
        "since": F.when(fresh & ~same, F.col("n.seen_at")).otherwise(F.col("since")),
        "last_seen": F.when(fresh, F.col("n.seen_at")).otherwise(F.col("last_seen")),
        "stable_at": F.when(fresh & ~same, F.when(F.lit(hold) <= 0, F.col("n.seen_at")))
        .when(fresh, F.coalesce("stable_at", held)).otherwise(F.col("stable_at")),
    }
    return rows.select(*place, *(v.cast("bigint" if c == "size" else "double").alias(c) for c, v in values.items()))


def stable_files(scans: DataFrame, hold: float = HOLD_SECONDS) -> DataFrame:
    """The state (`STABLE`) after all `scans` at once; the same as observing them one by one, in order of time."""
    place = ["library_id", "rel_path"]
    seen = scans.where("seen_at is not null").groupBy(*place, F.col("seen_at").cast("double").alias("seen_at")).agg(
        F.max(F.struct("size", "mtime")).alias("v")
    )
    before = previous_value(seen, place, F.col("seen_at"), [F.col("seen_at")], F.struct("v"), "before", _SPAN_SECONDS)
    changed = F.col("before").isNull() | ~F.col("before")["v"].eqNullSafe(F.col("v"))
    since = before.groupBy(*place).agg(
        F.max(F.when(changed, F.col("seen_at"))).alias("since"), F.max("seen_at").alias("last_seen"),
        F.max_by("v", "seen_at").alias("v"),
    )
    late = seen.select(*place, "seen_at").join(since.select(*place, "since"), place).where(F.col("seen_at") - F.col("since") >= hold)
    stable = late.groupBy(*place).agg(F.min("seen_at").alias("stable_at"))
    return since.join(stable, place, "left").select(
        *place, F.col("v.size").cast("bigint").alias("size"), F.col("v.mtime").cast("double").alias("mtime"), "since", "last_seen", "stable_at"
    )
