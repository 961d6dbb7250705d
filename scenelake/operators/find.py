"""One entry point for search: by index where there is one, else over the catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators.counts import any_analyzing
from scenelake.operators.ranking import routed_search
from scenelake.operators.search import SearchRequest, check_limit, result_rows, search_assets
from scenelake.sources.text_index import TextIndex

Table = DataFrame | Callable[[], DataFrame]


def index_hits(found: DataFrame) -> DataFrame:
    """Documents of an index search, one an asset, as hits."""
    return found.select(
        "asset_id", F.col("scene_start_ts").alias("best_scene_ts"), F.lit(None).cast("double").alias("match_ratio"),
        F.col("score").alias("base_rank"), F.col("rep_frame_path").alias("best_rep_frame_path"),
        F.col("score").alias("final_rank"),
    )


def _relative(hits: DataFrame) -> DataFrame:
    """Ranks as shares of the best one. `hits` is cut already, so one row gives the best."""
    best = hits.agg(F.max("final_rank")).scalar()
    return hits.withColumn("final_rank", F.col("final_rank") / F.nullif(best, F.lit(0.0)))


def _scopes(policy: DataFrame, library: DataFrame, req: SearchRequest) -> tuple[list[str], list[str]]:
    """Libraries in scope with an active index, and those without; a row per library comes to the driver."""
    known = library if req.include_deleted else library.where(F.col("deleted_at").isNull())
    if req.libraries:
        known = known.where(F.col("slug").isin(*req.libraries))
    active = policy.where(F.col("active_index_name").isNotNull()).select(F.col("library_slug").alias("slug")).distinct()
    rows = known.select("slug").join(active.withColumn("indexed", F.lit(True)), "slug", "left").collect()
    with_index = sorted(r["slug"] for r in rows if r["indexed"])
    return with_index, sorted(r["slug"] for r in rows if not r["indexed"])


def find(
    asset: DataFrame, scene: DataFrame, library: DataFrame, policy: DataFrame, documents: Table,
    postings: Table, req: SearchRequest, texts: TextIndex | None = None,
) -> DataFrame:
    """Hits as a user sees them, one an asset, with `searched` (index or catalog) and `incomplete`, whether libraries in
    scope are still being analysed.

    Words go to the index of each library that has one, and to the catalog for the others; a tag alone goes to the
    catalog. Where both take part, their ranks have no common scale: each counts as a share of the best rank on
    its side. `texts` are postings of the catalog, which are then read instead of its texts. `documents` and `postings` may be
    given as functions that make them; they are called only if a library in scope has an index.
    """
    check_limit(req)
    words = req.query or req.ocr_query
    slugs = list(req.libraries) or None
    indexed, others = _scopes(policy, library, req) if words else ([], [])
    by_index = by_catalog = None
    if indexed:
        documents, postings = (t if isinstance(t, DataFrame) else t() for t in (documents, postings))
        found = routed_search(
            documents, policy, library, words, indexed, req.types, req.limit, postings, req.tag,
            req.query is None, req.include_deleted, per_asset=True,
        )
        by_index = index_hits(found).withColumn("searched", F.lit("index"))
    if others or not indexed:
        scope = replace(req, libraries=tuple(others)) if indexed else req
        by_catalog = search_assets(asset, scene, library, scope, texts).withColumn("searched", F.lit("catalog"))
    if by_index is None or by_catalog is None:
        hits = by_catalog if by_index is None else by_index
    else:
        both = _relative(by_index).unionByName(_relative(by_catalog).select(by_index.columns))
        hits = both.orderBy(F.col("final_rank").desc(), "asset_id").limit(req.limit)
    flag = any_analyzing(asset, library, slugs).scalar()
    return result_rows(hits, asset, library, req.include_deleted).withColumn("incomplete", flag)
