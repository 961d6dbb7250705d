"""File inventories and raw metadata read from storage."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.exif import drop_vendor_keys
from scenelake.functions.paths import asset_type, has_suffix, suffix
from scenelake.schemas import MEDIA_SUFFIXES
from scenelake.session import cut_lineage


_LISTING = "path string, is_dir boolean, mtime double, size bigint, error string"


@dataclass(frozen=True)
class Inventory:
    """`files`: path, mtime and size. `unreadable`: path and error of folders that could not be listed, the root
    as an empty path. What lies below these isn't known, so it must not be taken for gone."""

    files: DataFrame
    unreadable: DataFrame


def _entries(folder: str) -> Iterator[tuple[str, bool | None, float | None, int | None, str | None]]:
    """Direct children of one folder, links passed over; a folder that can't be listed is itself a row."""
    try:
        if "://" not in folder:
            with os.scandir(folder) as found:
                for entry in found:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    if is_dir or entry.is_file(follow_symlinks=False):
                        info = entry.stat(follow_symlinks=False)
                        yield entry.path, is_dir, info.st_mtime, info.st_size, None
            return
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for info in fs.get_file_info(pa.fs.FileSelector(base)):
            name = f"{folder.rstrip('/')}/{info.base_name}"
            yield name, info.type == pa.fs.FileType.Directory, (info.mtime_ns or 0) / 1e9, info.size or 0, None
    except OSError as error:
        yield folder, None, None, None, str(error)


def _list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "is_dir", "mtime", "size", "error"]
    types = [pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.string()]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = _entries(folder)
            while chunk := list(itertools.islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), types)], names=names)


def take_inventory(spark: SparkSession, root: str) -> Inventory:
    """Path relative to the root, modification time in seconds (three decimals) and size of every file.

    One Spark job per level of the tree lists that level's folders in parallel, so only one folder at a time is
    held by a task. Empty files are listed too, which the `binaryFile` source would drop. Without a scheme the
    root must be a path that every executor sees.
    """
    base = root.rstrip("/")
    frontier = spark.createDataFrame([(base,)], "path string")
    found = None
    while True:
        spread = frontier.repartition(spark.sparkContext.defaultParallelism, "path")
        level = cut_lineage(spread.mapInArrow(_list_level, _LISTING))
        here = level.where("error is not null or not is_dir")
        found = here if found is None else found.unionByName(here)
        frontier = level.where("is_dir").select("path")
        if frontier.isEmpty():
            break
    below = F.expr(f"substring(path, {len(base) + 2})").alias("path")
    return Inventory(
        found.where("error is null").select(below, F.round("mtime", 3).alias("mtime"), "size"),
        found.where("error is not null").select(below, "error"),
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of `take_inventory`; a root that can't be listed is an error."""
    taken = take_inventory(spark, root)
    failed = taken.unreadable.where("path = ''").first()
    if failed is not None:
        raise FileNotFoundError(f"cannot list {root}: {failed['error']}")
    return taken.files


def unreadable_folders(spark: SparkSession, library_id: str, root: str) -> DataFrame:
    """(library_id, path, error) of a library's folders that could not be listed."""
    return take_inventory(spark, root).unreadable.select(F.lit(library_id).alias("library_id"), "path", "error")


def scan_library(spark: SparkSession, library_id: str, root: str) -> DataFrame:
    """Media files under a library root, with type and suffix."""
    files = list_files(spark, root)
    return files.where(has_suffix(F.col("path"), MEDIA_SUFFIXES)).select(
        F.lit(library_id).alias("library_id"), F.col("path").alias("rel_path"),
        asset_type(F.col("path")).alias("type"), "mtime", "size", suffix(F.col("path")).alias("ext"),
    )


def read_raw_metadata(spark: SparkSession, path: str, denied: Iterable[str] = ()) -> DataFrame:
    """One JSON object per line as a filtered string map, with the file it describes."""
    lines = spark.read.text(path)
    raw = F.from_json("value", "map<string,string>")
    return lines.select(raw.alias("raw")).select(
        F.col("raw")["SourceFile"].alias("source_file"),
        drop_vendor_keys(F.col("raw"), denied).alias("raw_exif"),
    )
