"""BM25 search and "more like this" over search documents.

The score is that of Robertson and Zaragoza (2009) with k1 = 1.2 and b = 0.75 over the words of
description, OCR text and tags together; document frequencies, the number of documents and their mean
length are those of the documents in scope.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.text import similarity_query, term_weights, tokens, words_of
from scenelake.session import cut_lineage
from scenelake.sources.search_docs import build_postings, n_words

K1, B = 1.2, 0.75

# Defaults of the adaptive similarity threshold.
MIN_SCORE, FLOOR, STEP, MIN_RESULTS, MAX_RESULTS = 0.65, 0.35, 0.10, 3, 20


def live_documents(rows: DataFrame, library: DataFrame) -> DataFrame:
    """Documents, or postings, of libraries that aren't in the trash."""
    live = library.where(F.col("deleted_at").isNull()).select(F.col("slug").alias("library_slug"))
    return rows.join(live, "library_slug", "left_semi")


def restrict(
    docs: DataFrame, libraries: Iterable[str] = (), types: Iterable[str] = ()
) -> DataFrame:
    """Documents of these libraries and of one asset type; videos have a scene id from 1 up."""
    libraries, types = list(libraries), set(types)
    if libraries:
        docs = docs.where(F.col("library_slug").isin(libraries))
    if types == {"image"}:
        docs = docs.where(F.col("scene_id") < 1)
    elif types == {"video"}:
        docs = docs.where(F.col("scene_id") >= 1)
    return docs


def bm25_scores(
    docs: DataFrame, weights: Mapping[str, float], match_all: bool, postings: DataFrame | None = None
) -> DataFrame:
    """(id, score) of the documents holding any, or all, of the weighted terms, with asset and scene where known.

    With stored `postings` of the same documents only rows of the query's terms are read; without, the
    texts are scanned and only occurrences of the terms leave the scan. Collection statistics are a
    one-row scalar and at most one row per query term.
    """
    terms = sorted(weights)
    if postings is None:
        found = build_postings(docs, terms)
    else:
        found = postings.where(F.col("term").isin(terms))
    collection = docs.agg(
        F.struct(F.count("*").alias("n"), F.avg(n_words(docs)).alias("mean"))
    ).scalar()
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = docs.sparkSession.createDataFrame(
        [(t, float(w)) for t, w in weights.items()], "term string, weight double"
    )
    idf = F.log(F.lit(1.0) + (F.col("c.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row per query term: bounded by the query, so broadcasting is safe at any data size.
    factors = F.broadcast(
        frequency.join(weighted, "term").withColumn("c", collection).select(
            "term", (idf * F.col("weight")).alias("factor"), F.col("c.mean").alias("mean")
        )
    )
    part = F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
    )
    # Summed as decimals: the same text has the same score, bit by bit, in whatever order its words come.
    part = (F.col("factor") * part).cast("decimal(38,20)")
    # Of which asset a document is comes with its postings.
    keys = [c for c in ("id", "asset_id", "scene_id") if c in found.columns]
    scores = found.join(factors, "term").groupBy(*keys).agg(
        F.sum(part).cast("double").alias("score"), F.count("*").alias("held")
    )
    if match_all:
        scores = scores.where(F.col("held") == len(terms))
    return scores.select(*keys, "score")


def bm25_search(
    docs: DataFrame, query: str | None, libraries: Iterable[str] = (), types: Iterable[str] = (),
    limit: int = 50, postings: DataFrame | None = None, tag: str | None = None, ocr: bool = False,
    per_asset: bool = False,
) -> DataFrame:
    """The best documents holding every query word, one row per document; none for an empty query. With `per_asset`
    the best document of each of the best assets, of equal ones the earliest scene.

    With `tag` only documents that carry it; with `ocr` the words must stand in the OCR text. Both restrict the
    scope, so that statistics are those of the documents that may be found.
    """
    scope = restrict(docs, libraries, types)
    words = words_of(query or "")
    if not words:
        return scope.withColumn("score", F.lit(0.0)).where(F.lit(False))
    narrowed = None if postings is None else restrict(postings, libraries, types)
    whole, counted = scope, None
    if tag or ocr:
        if tag:
            scope = scope.where(F.array_contains("tags", tag))
        if ocr:
            held = tokens(F.coalesce("ocr_text", F.lit("")))
            scope = scope.where(F.size(F.array_except(F.array(*map(F.lit, words)), held)) == 0)
        if narrowed is not None:
            # Which documents are in scope is found once: it takes their texts.
            counted = cut_lineage(scope.select("id", "index_name", n_words(scope).alias("n_words")))
            narrowed = narrowed.join(counted.select("id", "index_name"), ["id", "index_name"], "left_semi")
    scores = bm25_scores(scope if counted is None else counted, dict.fromkeys(words, 1), match_all=True, postings=narrowed)
    order = "id"
    if per_asset:
        best = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("scene_id")))
        scores, order = scores.groupBy("asset_id").agg(best.alias("best")).select("asset_id", "best.*"), "asset_id"
    top = scores.orderBy(F.col("score").desc(), order).limit(limit).select("id", "score")
    if counted is None:
        return scope.join(top, "id")
    placed = counted.select("id", "index_name").join(top, "id")
    return whole.join(placed, ["id", "index_name"]).select(*scope.columns, "score")


def active_documents(
    docs: DataFrame, policy: DataFrame, library: DataFrame, libraries: Iterable[str] | None = None,
    include_deleted: bool = False,
) -> DataFrame:
    """Documents of the active indexes of the libraries; `index_name` partitions are pruned. Libraries in the
    trash are left out before any statistic or cut, unless asked for."""
    rows = policy.where(F.col("active_index_name").isNotNull())
    if libraries is not None:
        rows = rows.where(F.col("library_slug").isin(list(libraries)))
    names = rows.select(F.col("active_index_name").alias("index_name"))
    found = docs.join(names, "index_name", "left_semi")
    return found if include_deleted else live_documents(found, library)


def routed_search(
    docs: DataFrame, policy: DataFrame, library: DataFrame, query: str, libraries: Iterable[str] | None = None,
    types: Iterable[str] = (), limit: int = 50, postings: DataFrame | None = None, tag: str | None = None,
    ocr: bool = False, include_deleted: bool = False, per_asset: bool = False,
) -> DataFrame:
    scope, narrowed = (
        t if t is None else active_documents(t, policy, library, libraries, include_deleted) for t in (docs, postings)
    )
    return bm25_search(scope, query, libraries or (), types, limit, narrowed, tag, ocr, per_asset)


def has_active_index(policy: DataFrame, libraries: Iterable[str] | None = None) -> bool:
    """Whether index search is possible; otherwise callers use text search over the catalog."""
    rows = policy.where(F.col("active_index_name").isNotNull())
    if libraries is not None:
        rows = rows.where(F.col("library_slug").isin(list(libraries)))
    return not rows.isEmpty()


def shadow_search(
    docs: DataFrame, index_name: str, library: DataFrame, query: str, limit: int = 50,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Search one named index whatever the policy says; libraries in the trash are left out."""
    scope, narrowed = (
        t if t is None else live_documents(t.where(F.col("index_name") == index_name), library)
        for t in (docs, postings)
    )
    return bm25_search(scope, query, limit=limit, postings=narrowed)


@dataclass(frozen=True)
class Camera:
    make: str | None = None
    model: str | None = None


@dataclass(frozen=True)
class SimilarityScope:
    """Restrictions on similar assets; the defaults restrict nothing."""

    library: str | None = None
    asset_types: tuple[str, ...] = ()
    from_ts: float | None = None
    to_ts: float | None = None
    min_sharpness: float | None = None
    has_face: bool | None = None
    cameras: tuple[Camera, ...] = field(default=())

    @property
    def told_by_postings(self) -> bool:
        """Whether it looks only at what postings hold of their documents."""
        return self.cameras == () and all(v is None for v in (self.from_ts, self.to_ts, self.min_sharpness, self.has_face))

    def condition(self, exclude_asset_id: int) -> Column:
        video = {("image",): False, ("video",): True}.get(tuple(sorted(set(self.asset_types))))
        limits = (
            ("library_slug", Column.__eq__, None if self.library == "all" else self.library),
            ("capture_ts", Column.__ge__, self.from_ts),
            ("capture_ts", Column.__le__, self.to_ts),
            ("sharpness_score", Column.__ge__, self.min_sharpness),
            ("has_face", Column.__eq__, self.has_face),
        )
        out = F.col("asset_id") != exclude_asset_id
        for name, compare, value in limits:
            if value is not None:
                out = out & compare(F.col(name), F.lit(value))
        if video is not None:
            out = out & ((F.col("scene_id") >= 1) == F.lit(video))
        wanted = [tuple((v or "").strip() or None for v in (c.make, c.model)) for c in self.cameras]
        wanted = [w for w in wanted if any(w)]
        if wanted:
            # A camera names a make, a model or both; what it leaves open fits anything.
            kind = "array<struct<make:string,model:string>>"
            cameras = F.array(*(F.struct(*(F.lit(v) for v in w)) for w in wanted)).cast(kind)
            fits = lambda own, value: value.isNull() | F.coalesce(F.col(own) == value, F.lit(False))
            out = out & F.exists(
                cameras, lambda c: fits("camera_make", c["make"]) & fits("camera_model", c["model"])
            )
        return out


def thresholds(min_score: float, floor: float, step: float) -> list[float]:
    """Thresholds tried in turn, by repeated subtraction; a step that does not descend means one try."""
    step = step if step > 0 else min_score
    tried, value = [], float(min_score)
    while value >= floor:
        tried.append(value)
        if step <= 0:
            break
        value -= step
    return tried


def adaptive_cut(
    hits: DataFrame, min_score: float = MIN_SCORE, floor: float = FLOOR, step: float = STEP,
    min_results: int = MIN_RESULTS,
) -> DataFrame:
    """Keep hits above the first threshold that leaves enough, else above the last one tried.

    Adds `threshold_used`. `hits` is already cut to its maximum number, so one pass counts all
    thresholds at once.
    """
    tried = thresholds(min_score, floor, step)
    if not tried:
        return hits.withColumn("threshold_used", F.lit(float(floor))).where(F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    counts = hits.agg(*[F.count_if(score >= t).alias(f"n{i}") for i, t in enumerate(tried)])
    enough = [F.when(F.col(f"n{i}") >= min_results, F.lit(t)) for i, t in enumerate(tried)]
    chosen = counts.select(F.coalesce(*enough, F.lit(tried[-1]))).scalar()
    return hits.withColumn("threshold_used", chosen).where(score >= F.col("threshold_used"))


def find_similar(
    docs: DataFrame, description: str | None, tags: Iterable[str], exclude_asset_id: int,
    scope: SimilarityScope = SimilarityScope(), max_results: int = MAX_RESULTS,
    postings: DataFrame | None = None, **cut: float,
) -> DataFrame:
    """Documents like a description and tags, best first, above the adaptive threshold."""
    spark = docs.sparkSession
    source = spark.createDataFrame([(description, list(tags))], "d string, t array<string>")
    text = source.select(similarity_query(F.col("d"), F.col("t")).alias("q")).first()["q"]
    weights = term_weights(text or "")
    inside = docs.where(scope.condition(exclude_asset_id))
    if not weights:
        empty = inside.withColumn("score", F.lit(0.0)).withColumn("threshold_used", F.lit(FLOOR))
        return empty.where(F.lit(False))
    if postings is not None:
        if scope.told_by_postings and {"asset_id", "scene_id", "library_slug"} <= set(postings.columns):
            postings = postings.where(scope.condition(exclude_asset_id))
        else:
            postings = postings.join(inside.select("id"), "id", "left_semi")
    scores = bm25_scores(inside, weights, match_all=False, postings=postings)
    top = scores.select("id", "score").orderBy(F.col("score").desc(), "id").limit(max_results)
    return inside.join(adaptive_cut(top, **cut), "id")


def similar_assets(
    docs: DataFrame, asset: DataFrame, policy: DataFrame, library: DataFrame, asset_id: int,
    scope: SimilarityScope = SimilarityScope(), postings: DataFrame | None = None, **options: float,
) -> DataFrame:
    """Documents of active indexes like one asset, whose own text is the query."""
    row = asset.where(F.col("id") == asset_id).select("visual_analysis").first()
    if row is None:
        raise ValueError(f"no asset {asset_id}")
    analysis = row[0]
    if analysis is None or not (analysis["description"] or analysis["tags"]):
        raise ValueError(f"asset {asset_id} has no description or tags to compare by")
    slugs = None if scope.library in (None, "all") else [scope.library]
    if postings is not None:
        postings = active_documents(postings, policy, library, slugs)
    return find_similar(
        active_documents(docs, policy, library, slugs), analysis["description"], analysis["tags"] or [],
        asset_id, scope, postings=postings, **options,
    )
