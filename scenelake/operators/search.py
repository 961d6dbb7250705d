"""Ranked text search and tag search over images and video scenes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.paths import (
    base_name, media_url, mm_ss, preview_url, thumbnail_url,
)
from scenelake.functions.stem import stem
from scenelake.functions.text import (
    Clause, cover_rank, cover_rank_at, matches, matches_at, normalise, parse_query, terms_of,
)
from scenelake.operators.catalog import live_assets
from scenelake.sources.text_index import TextIndex

MAX_LIMIT = 500


@dataclass(frozen=True)
class SearchRequest:
    """What to look for and where. Deleted libraries are left out unless asked for."""

    query: str | None = None
    ocr_query: str | None = None
    libraries: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    tag: str | None = None
    limit: int = 50
    include_deleted: bool = False
    full_duration: bool = False


def in_scope(asset: DataFrame, library: DataFrame, req: SearchRequest, kind: str) -> DataFrame:
    """Assets of one type that a request may find."""
    rows = asset.where(F.col("type") == kind)
    if req.types and kind not in req.types:
        rows = rows.where(F.lit(False))
    if req.libraries:
        rows = rows.where(F.col("library_id").isin(*req.libraries))
    return rows if req.include_deleted else live_assets(rows, library)


def search_text(analysis: Column, ocr_only: bool) -> Column:
    """The text of an analysis that is searched."""
    if ocr_only:
        return F.coalesce(analysis["ocr_text"], F.lit(""))
    return F.concat_ws(
        " ", analysis["description"], F.array_join(analysis["tags"], " "), analysis["ocr_text"]
    )


def _may_match(text: Column, clauses: list[Clause]) -> Column:
    """Cheap necessary condition, so that only promising rows pay for normalisation."""
    low = F.lower(text)

    def one(clause: Clause) -> Column:
        return reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in clause.terms], F.lit(True))

    return reduce(lambda a, b: a | b, [one(c) for c in clauses])


def ranked(rows: DataFrame, text: Column, clauses: list[Clause]) -> DataFrame:
    """Rows whose text satisfies the query, with their rank."""
    normal = normalise(text)
    hit = rows.where(_may_match(text, clauses)).where(matches(normal, clauses))
    return hit.withColumn("rank", cover_rank(F.split(F.trim(normal), " "), clauses))


def stemmed(clauses: list[Clause]) -> list[Clause]:
    """The same query over stems."""
    parts = lambda ps: tuple(tuple(map(stem, p)) for p in ps)
    return [Clause(tuple(map(stem, c.words)), parts(c.phrases), parts(c.excluded)) for c in clauses]


def found_at(index: TextIndex, clauses: list[Clause], field: str | None = None) -> DataFrame:
    """Images and scenes (kind, id, asset_id, start_ts, end_ts, rank) that satisfy a query, from postings alone.

    Every alternative needs a word that must occur. `field` keeps to the `description` or the `ocr` text. What is
    gathered per text is one row per word of the query.
    """
    if any(not c.terms for c in clauses):
        raise ValueError("an alternative without a word that must occur can't be answered from postings")
    if index.stemmed:
        clauses = stemmed(clauses)
    terms = sorted({*terms_of(clauses), *(w for c in clauses for p in c.excluded for w in p)})
    rows = index.rows("word", terms)
    inside = {
        None: F.col("places"),
        "ocr": F.filter("places", lambda p: p > F.col("ocr_from")),
        "description": F.filter("places", lambda p: p <= F.col("described")),
    }[field]
    rows = rows.withColumn("places", inside).where(F.size("places") > 0)
    texts = rows.groupBy("kind", "id", "asset_id", "start_ts", "end_ts").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "places"))).alias("held")
    )
    hits = texts.where(matches_at(F.col("held"), clauses))
    return hits.select("kind", "id", "asset_id", "start_ts", "end_ts", cover_rank_at(F.col("held"), clauses).alias("rank"))


def indexed_rows(index: TextIndex, req: SearchRequest, clauses: list[Clause] | None) -> DataFrame:
    """Images and scenes that a request finds in the index, whatever their library."""
    tagged = index.rows("tag", [req.tag]).select("kind", "id", "asset_id", "start_ts", "end_ts") if req.tag else None
    if clauses is None:
        return tagged.withColumn("rank", F.lit(1.0))
    found = found_at(index, clauses, "ocr" if req.ocr_query is not None else None)
    return found if tagged is None else found.join(tagged.select("kind", "id"), ["kind", "id"], "left_semi")


def _as_image_hits(rows: DataFrame, asset_id: str) -> DataFrame:
    return rows.select(
        F.col(asset_id).alias("asset_id"),
        F.lit(None).cast("double").alias("best_scene_ts"),
        F.lit(1.0).alias("match_ratio"),
        F.col("rank").alias("base_rank"),
        F.lit(None).cast("string").alias("best_rep_frame_path"),
    )


def _indexed_hits(
    asset: DataFrame, scene: DataFrame, library: DataFrame, req: SearchRequest, clauses: list[Clause] | None, index: TextIndex
) -> DataFrame:
    """Hits from the index. The catalog gives which assets count and the frames of the best scenes, never a text."""
    rows = indexed_rows(index, req, clauses)
    owners = [in_scope(asset, library, req, kind).select(F.col("id").alias("asset_id")) for kind in ("image", "video")]
    images = _as_image_hits(rows.where("kind = 'image'").join(owners[0], "asset_id", "left_semi"), "asset_id")
    scenes = rows.where("kind = 'scene'").join(owners[1], "asset_id", "left_semi")
    videos = _per_video(scenes, F.struct("start_ts", "id"))
    if req.full_duration:
        videos = _over_whole(videos, scene)
    frames = scene.select(F.col("id").alias("best_id"), "rep_frame_path")
    shown = videos.withColumn("best_id", F.col("best.id")).join(frames, "best_id", "left")
    return images.unionByName(_as_video_hits(shown, F.col("rep_frame_path")))


def image_hits(asset: DataFrame, req: SearchRequest, clauses: list[Clause] | None) -> DataFrame:
    rows = asset.where(F.col("visual_analysis").isNotNull())
    if req.tag:
        rows = rows.where(F.array_contains("visual_analysis.tags", req.tag))
    if clauses is None:
        rows = rows.withColumn("rank", F.lit(1.0))
    else:
        rows = ranked(rows, search_text(F.col("visual_analysis"), req.ocr_query is not None), clauses)
    return _as_image_hits(rows, "id")


def _per_video(rows: DataFrame, best: Column) -> DataFrame:
    """Matching scenes rolled up: of the best one what is asked for, and the share of matching time."""
    return rows.groupBy("asset_id").agg(
        F.max_by(best, F.struct("rank", -F.col("start_ts"), -F.col("id"))).alias("best"),
        F.sum(F.col("end_ts") - F.col("start_ts")).alias("matched"), F.max("end_ts").alias("total"),
        F.max("rank").alias("base_rank"),
    )


def _over_whole(videos: DataFrame, scene: DataFrame) -> DataFrame:
    """Measured against the last scene of the video, matching or not."""
    ends = scene.groupBy("asset_id").agg(F.max("end_ts").alias("total"))
    return videos.drop("total").join(ends, "asset_id")


def _as_video_hits(videos: DataFrame, frame: Column) -> DataFrame:
    return videos.select(
        "asset_id", F.col("best.start_ts").alias("best_scene_ts"),
        (F.col("matched") / F.nullif(F.col("total"), F.lit(0.0))).alias("match_ratio"),
        "base_rank", frame.alias("best_rep_frame_path"),
    )


def video_hits(scene: DataFrame, req: SearchRequest, clauses: list[Clause] | None) -> DataFrame:
    """Matching scenes rolled up per video.

    The share of matching time is relative to the end of the last *matching* scene; `full_duration`
    measures against the last scene of the video instead.
    """
    rows = scene.where(F.col("metadata").isNotNull())
    if req.tag:
        rows = rows.where(F.array_contains("metadata.analysis.tags", req.tag))
    if clauses is None:
        rows = rows.withColumn("rank", F.lit(1.0))
    else:
        rows = ranked(rows, search_text(F.col("metadata.analysis"), req.ocr_query is not None), clauses)
    videos = _per_video(rows, F.struct("start_ts", "rep_frame_path"))
    if req.full_duration:
        videos = _over_whole(videos, scene)
    return _as_video_hits(videos, F.col("best.rep_frame_path"))


def all_hits(
    asset: DataFrame, scene: DataFrame, library: DataFrame, req: SearchRequest, index: TextIndex | None = None
) -> DataFrame:
    """Every hit with its final rank, before the top-k cut.

    With an `index` only postings of the query's words and tag are read, and no text. Without one, and for a query
    with an alternative that only excludes, texts are scanned.
    """
    clauses = None
    if req.query or req.ocr_query:
        clauses = parse_query(req.query or req.ocr_query)
    if clauses is None and not req.tag or clauses == []:
        none = asset.where(F.lit(False))
        images = image_hits(none, replace(req, tag="-"), None)
        return images.withColumn("final_rank", F.col("base_rank"))
    if index is not None and all(c.terms for c in clauses or ()):
        hits = _indexed_hits(asset, scene, library, req, clauses, index)
    else:
        if index is not None and index.stemmed:
            raise ValueError("a query that only excludes can't be searched by stems")
        owners = in_scope(asset, library, req, "video").select(F.col("id").alias("asset_id"))
        videos = video_hits(scene, req, clauses).join(owners, "asset_id", "left_semi")
        hits = image_hits(in_scope(asset, library, req, "image"), req, clauses).unionByName(videos)
    boost = F.lit(1.0) + F.coalesce("match_ratio", F.lit(0.0)) * 2.0
    return hits.withColumn("final_rank", F.col("base_rank") * boost)


def check_limit(req: SearchRequest) -> None:
    if not 1 <= req.limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")


def search_assets(
    asset: DataFrame, scene: DataFrame, library: DataFrame, req: SearchRequest, index: TextIndex | None = None
) -> DataFrame:
    """The `limit` best hits; equal ranks are ordered by asset id."""
    check_limit(req)
    return top_hits(all_hits(asset, scene, library, req, index), req.limit)


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.col("final_rank").desc(), "asset_id").limit(limit)


def with_confidence(hits: DataFrame) -> DataFrame:
    """Percentage of the best rank and its band, over an already limited result."""
    best = F.max("final_rank").over(Window.partitionBy(F.lit(0)))
    pct = F.when(best > 0, F.bround(F.lit(100.0) * F.col("final_rank") / best).cast("bigint"))
    band = F.when(pct > 80, "high").when(pct > 50, "medium").when(pct.isNotNull(), "low")
    return hits.withColumn("confidence", pct).withColumn("band", band)


def result_rows(hits: DataFrame, asset: DataFrame, library: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Hits with links, labels and library names, as shown to a user; of live assets unless others are asked for."""
    own = (asset if include_deleted else live_assets(asset, library)).select(
        F.col("id").alias("asset_id"), "library_id", "rel_path", "type", "status", "error_message",
        "video_preview_path",
    )
    names = library.select(F.col("slug").alias("library_id"), F.coalesce("name", "slug").alias("named"))
    rows = hits.join(own, "asset_id").join(names, "library_id", "left")
    return rows.select(
        "asset_id", "type",
        thumbnail_url(F.col("library_id"), F.col("asset_id"), F.col("status")).alias("thumbnail_url"),
        preview_url(F.col("type"), F.col("best_rep_frame_path")).alias("preview_url"),
        media_url(F.col("video_preview_path")).alias("video_preview_url"),
        "status", "error_message", "final_rank",
        F.round(F.coalesce("match_ratio", F.lit(0.0)) * 100.0, 1).alias("match_ratio"),
        mm_ss(F.col("best_scene_ts")).alias("best_scene_ts"),
        F.col("best_scene_ts").alias("best_scene_ts_seconds"),
        F.col("library_id").alias("library_slug"),
        F.coalesce("named", "library_id").alias("library_name"),
        base_name(F.col("rel_path")).alias("filename"),
        *(c for c in ("searched",) if c in hits.columns),
    )
