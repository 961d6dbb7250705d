"""Positional postings of the catalog's texts: built, kept up to date, and merged on reading.

A posting says where one word stands in the text of one image or scene: description, tags and OCR text one after
the other, places numbered through. `described` is the last place of the description, `ocr_from` the last one before
the OCR text, so a search may keep to a field. Exact tags are postings of their own (`field` is `tag`), without
places. Postings are written where they are made, nothing is shuffled: a file holds those of the texts that one task reads,
in runs of some hundred thousand, each by (field, term). A query reads about a page of each run for each of its words, and
a word found everywhere is spread over all files.

Batches are never changed. What an asset had in older batches is void once a tombstone of a later version names it;
`merged` leaves it out, and `compact` writes what is left as one batch elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from scenelake.functions.stem import stem
from scenelake.functions.text import tokens
from scenelake.session import PACKED, cut_lineage

POSTING = (
    "kind string, id bigint, asset_id bigint, start_ts double, end_ts double, described int, ocr_from int, "
    "field string, term string, places array<int>, version bigint"
)
TOMBSTONE = "asset_id bigint, version bigint"
#: Words that are put in order together, more only if a single text has more; a text without words counts as one.
WORDS_AT_ONCE = 1 << 20
#: Postings that `in_runs` puts in order together, and rows that go back from Python together.
POSTINGS_AT_ONCE, _ROWS_BACK = 1 << 20, 1 << 16
#: Assets that every task is told of, some 25 MB, rather than that all postings or texts are shuffled to meet them.
ASSETS_TOLD = 1 << 19
#: Rows of a page, of which a query reads at least one in each run.
_PAGE_ROWS = 5000


@dataclass(frozen=True)
class TextIndex:
    """`postings` as written, and `tombstones` (asset_id, version). `stemmed`: terms of words are stems."""

    postings: DataFrame
    tombstones: DataFrame
    stemmed: bool = False

    def rows(self, field: str, terms: list[str]) -> DataFrame:
        """Postings of these terms that still hold."""
        return merged(self.postings.where((F.col("field") == field) & F.col("term").isin(terms)), self.tombstones)


def _told_if_few(assets: DataFrame) -> DataFrame:
    """Rows of some 16 bytes an asset, for all tasks if there are at most ASSETS_TOLD. More are left to Catalyst."""
    few = assets.limit(ASSETS_TOLD + 1).count() <= ASSETS_TOLD
    return F.broadcast(assets) if few else assets


def merged(rows: DataFrame, tombstones: DataFrame, whole: bool = False) -> DataFrame:
    """Rows with a `version` that no later tombstone of their asset makes void. `whole`: all postings of an index, which
    shall not be shuffled."""
    last = tombstones.groupBy("asset_id").agg(F.max("version").alias("void_before"))
    last = _told_if_few(last) if whole else last
    held = rows.join(last, "asset_id", "left").where(F.col("void_before").isNull() | (F.col("version") >= F.col("void_before")))
    return held.select(rows.columns)


def _texts(asset: DataFrame, scene: DataFrame) -> DataFrame:
    """Analysed images, and analysed scenes whatever their asset; a search decides which assets count."""

    def row(kind: str, asset_id: Column, start: Column, end: Column, analysis: Column) -> list[Column]:
        return [
            F.lit(kind).alias("kind"), F.col("id"), asset_id.alias("asset_id"), start.cast("double").alias("start_ts"),
            end.cast("double").alias("end_ts"), analysis["description"].alias("description"),
            analysis["tags"].alias("tags"), analysis["ocr_text"].alias("ocr_text"),
        ]

    nothing = F.lit(None)
    images = asset.where((F.col("type") == "image") & F.col("visual_analysis").isNotNull())
    scenes = scene.where(F.col("metadata").isNotNull())
    return images.select(row("image", F.col("id"), nothing, nothing, F.col("visual_analysis"))).unionByName(
        scenes.select(row("scene", F.col("asset_id"), F.col("start_ts"), F.col("end_ts"), F.col("metadata.analysis")))
    )


def _slices(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, _ROWS_BACK):
        yield rows.slice(at, _ROWS_BACK)


def _ranks(values: pa.Array) -> np.ndarray:
    """The place of each of the different values in their order, that of their bytes."""
    ranks = np.empty(len(values), np.int64)
    ranks[pc.sort_indices(values).to_numpy()] = np.arange(len(values))
    return ranks


def each_word(texts: DataFrame, stems: bool = False, counted: bool = False) -> DataFrame:
    """(..., field, term, places) of (..., words) or (..., words, tags): a row for each different word of a text, or for
    each different stem, and one without places for each different tag. They come in runs, each by (field, term).

    All places of a word stand in its text's own row, so nothing is shuffled, and texts are read once for both. With
    `counted` there is `tf`, the number of places, instead, and rows come text by text.
    """
    shared = [f for f in texts.schema.fields if f.name not in ("words", "tags")]
    names, tagged = [f.name for f in shared], "tags" in texts.columns
    value, kind = ("tf", LongType()) if counted else ("places", ArrayType(IntegerType()))

    def rows(part: pa.RecordBatch, row: np.ndarray, field: str, term: pa.Array, places: pa.Array) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [*(part.column(n).take(at) for n in names), pa.array([field]).take(pa.array(np.zeros(len(row), np.int64))), term, places],
            names=[*names, "field", "term", value],
        )

    def held(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """For each value of the lists its row and its place there, from 1."""
        flat, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        return row, np.arange(1, len(row) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes), flat

    def placed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, place, flat = held(part.column("words"))
        if len(row):
            term, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
            if stems:
                of_words = pa.array([stem(w) for w in term.to_pylist()], term.type).dictionary_encode()
                term, code = of_words.dictionary, of_words.indices.to_numpy().astype(np.int64)[code]
            key = row * len(term) + code if counted else _ranks(term)[code] * part.num_rows + row
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(row))
            if counted:
                places = pa.array(np.diff(ends), pa.int64())
            else:
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            yield rows(part, row[order][first], "word", term.take(pa.array(code[order][first])), places)
        if tagged:
            row, _, flat = held(part.column("tags"))
            known = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                code = flat.indices.fill_null(0).to_numpy().astype(np.int64)
                names_of = flat.dictionary.take(pc.sort_indices(flat.dictionary))
                key = np.unique(_ranks(flat.dictionary)[code[known]] * part.num_rows + row[known])
                code, row = np.divmod(key, part.num_rows)
                if counted:
                    nothing = pa.array(np.zeros(len(row)), pa.int64())
                else:
                    nothing = pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1), pa.int32()), pa.array([], pa.int32()))
                yield rows(part, row, "tag", names_of.take(pa.array(code)), nothing)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with WORDS_AT_ONCE words together, however they are batched."""
        waiting, room = [], WORDS_AT_ONCE
        for batch in batches:
            upto = np.cumsum(np.maximum(pc.list_value_length(batch.column("words")).fill_null(0).to_numpy(), 1))
            at = 0
            while at < len(upto):
                done = upto[at - 1] if at else 0
                end = int(np.searchsorted(upto, done + room, "right"))
                if not waiting:
                    end = max(at + 1, end)
                if end > at:
                    waiting.append(batch.slice(at, end - at))
                    room -= upto[end - 1] - done
                    at = end
                if at < len(upto):
                    yield pa.concat_batches(waiting)
                    waiting, room = [], WORDS_AT_ONCE
        if waiting:
            yield pa.concat_batches(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            for made in placed(part):
                yield from _slices(made)

    schema = StructType(shared).add("field", StringType()).add("term", StringType()).add(value, kind)
    return texts.mapInArrow(run, schema)


def build_postings(asset: DataFrame, scene: DataFrame, version: int = 0, stems: bool = False, words: bool = True) -> DataFrame:
    """Postings of all words, or of their `stems`, and of all tags. Null fields hold no words; a text without words
    has no postings. Without `words` only those of tags: no text is read, and fields have no places."""
    texts, shared = _texts(asset, scene), ["kind", "id", "asset_id", "start_ts", "end_ts"]
    if words:
        parts = texts.select(
            *shared, tokens(F.col("description")).alias("d"), tokens(F.array_join("tags", " ")).alias("t"),
            tokens(F.col("ocr_text")).alias("o"), "tags",
        )
        sized = parts.withColumns({"described": F.size("d"), "ocr_from": F.size("d") + F.size("t"), "words": F.concat("d", "t", "o")})
    else:
        none = {"described": F.lit(None).cast("int"), "ocr_from": F.lit(None).cast("int"), "words": F.array().cast("array<string>")}
        sized = texts.withColumns(none)
    both = each_word(sized.select(*shared, "described", "ocr_from", "words", "tags"), stems)
    return both.withColumn("version", F.lit(version).cast("bigint")).select([part.split()[0] for part in POSTING.split(", ")])


def different_words(asset: DataFrame, scene: DataFrame) -> DataFrame:
    """(term): every word of the texts once. What is shuffled is a word per task, not per text."""
    every = F.concat(*map(tokens, (F.col("description"), F.array_join("tags", " "), F.col("ocr_text"))))
    return _texts(asset, scene).select(F.explode(every).alias("term")).distinct()


def word_stems(words: DataFrame) -> DataFrame:
    """(term, stem) of the different values of (term): each word is stemmed once, however often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems = [stem(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stems, pa.string())], names=["term", "stem"])

    return words.select("term").distinct().mapInArrow(run, "term string, stem string")


def stemmed_postings(postings: DataFrame, words: DataFrame) -> DataFrame:
    """Postings by stem: places of all words with the same stem in one row. Tags stay whole."""
    shared = [c for c in postings.columns if c not in ("term", "places")]
    whole = postings.where("field = 'word'").join(words, "term").groupBy(*shared, F.col("stem").alias("term")).agg(
        F.sort_array(F.flatten(F.collect_list("places"))).alias("places")
    )
    return whole.select(postings.columns).unionByName(postings.where("field <> 'word'"))


def in_runs(postings: DataFrame) -> DataFrame:
    """Postings in any order, in runs, each by (field, term, id). Nothing is shuffled, and a task holds one run."""

    def ordered(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_batches(batches)
        ranks = []
        for name in ("field", "term"):
            values = rows.column(name).dictionary_encode()
            ranks.append(_ranks(values.dictionary)[values.indices.to_numpy()])
        order = np.lexsort((rows.column("id").to_numpy(), ranks[1], ranks[0]))
        yield from _slices(rows.take(pa.array(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > POSTINGS_AT_ONCE:
                yield from ordered(waiting)
                waiting, n = [], 0
            waiting.append(batch)
            n += batch.num_rows
        if n:
            yield from ordered(waiting)

    return postings.mapInArrow(run, postings.schema)


def _write(rows: DataFrame, path: str, version: int) -> None:
    """Replace one batch; others are untouched."""
    # As Parquet counts a page's rows.
    pages = {"parquet.page.row.count.limit": str(_PAGE_ROWS)}
    rows.write.mode("overwrite").options(**PACKED, **pages).parquet(f"{path}/batch={version}")


def write_index(postings: DataFrame, path: str, version: int = 0) -> None:
    """Write a batch of postings as they come: those of `build_postings` come in runs, others go through `in_runs`."""
    _write(postings, f"{path}/postings", version)


def write_tombstones(assets: DataFrame, path: str, version: int) -> None:
    """Make void what the assets (asset_id) have in batches before `version`."""
    rows = assets.select(F.col("asset_id").cast("bigint").alias("asset_id")).distinct()
    _write(rows.withColumn("version", F.lit(version).cast("bigint")), f"{path}/tombstones", version)


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """Tombstones below a folder; none if there never were any."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tombstones")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        # Of known size, so that no join takes it for a large table.
        return spark.sql("select cast(null as bigint) as asset_id, cast(null as bigint) as version where false")
    return spark.read.schema(TOMBSTONE).parquet(f"{path}/tombstones")


def read_index(spark: SparkSession, path: str, stemmed: bool = False, base: TextIndex | None = None) -> TextIndex:
    """The index below a folder. With `base` the folder holds only changes to that index, which stays as it is."""
    own = spark.read.schema(POSTING).parquet(f"{path}/postings")
    postings, tombstones = own, read_tombstones(spark, path)
    if base is not None:
        columns, marks = base.postings.columns, ["asset_id", "version"]
        postings = base.postings.unionByName(own.select(columns))
        tombstones = base.tombstones.select(marks).unionByName(tombstones.select(marks))
    return TextIndex(postings, tombstones, stemmed)


def compact(spark: SparkSession, path: str, to: str, stemmed: bool = False, base: TextIndex | None = None) -> TextIndex:
    """Write what still holds as one batch to another folder; readers of the old one are not disturbed. With `base` the
    folder holds only changes to that index.

    Versions stay, so batches written to the new folder afterwards go on counting.
    """
    index = read_index(spark, path, stemmed, base)
    write_index(in_runs(merged(index.postings, index.tombstones, whole=True)), to)
    return read_index(spark, to, stemmed)


def last_actions(outbox: DataFrame) -> DataFrame:
    """(asset_id, action): the latest of each asset's queued changes (seq, asset_id, action UPSERT or DELETE)."""
    return outbox.where("asset_id is not null").groupBy("asset_id").agg(F.max_by("action", "seq").alias("action"))


def apply_changes(outbox: DataFrame, asset: DataFrame, scene: DataFrame, path: str, version: int, stemmed: bool = False) -> None:
    """Bring queued changes into the index, as one batch of postings and tombstones.

    An asset that is to be upserted and is no longer there counts as deleted. Tombstones come first, so no reader
    ever sees old and new postings of an asset together; after a failure in between, the same version run again
    replaces both parts.
    """
    if version < 1:
        raise ValueError("version 0 is the first build; changes count from 1")
    actions = cut_lineage(last_actions(outbox))
    changed = _told_if_few(actions.where("action = 'UPSERT'").select("asset_id"))
    images = asset.join(changed.withColumnRenamed("asset_id", "id"), "id", "left_semi")
    postings = build_postings(images, scene.join(changed, "asset_id", "left_semi"), version, stemmed)
    write_tombstones(actions, path, version)
    write_index(postings, path, version)
