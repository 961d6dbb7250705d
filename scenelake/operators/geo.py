"""Nearest place by great-circle distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

# Edges of the cells, finest first, in Earth radii: 640 km and thirds of it, down to about 100 m.
CELL_EDGES = tuple(0.1 / 3**i for i in range(8, -1, -1))
# The first cells tried are the widest in which a place has so many others beside it, on average, at most.
NEIGHBOURS = 4
AXES = ("x", "y", "z")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Central angle in radians."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Adds the point's place on the unit sphere. Cells in space know neither poles nor a date line."""
    a, o = F.radians(lat), F.radians(lon)
    return df.withColumns({"x": F.cos(a) * F.cos(o), "y": F.cos(a) * F.sin(o), "z": F.sin(a)})


def _cells(edge: float) -> list[Column]:
    return [F.floor(F.col(c) / edge).cast("int").alias(f"c_{c}") for c in AXES]


def _first_edge(places: DataFrame) -> int:
    """Which of `CELL_EDGES` to begin with, by how densely the places lie; a row per edge comes to the driver."""
    edges = F.explode(F.array(*map(F.lit, CELL_EDGES))).alias("edge")
    sizes = places.select(*AXES, edges).groupBy("edge", *(F.floor(F.col(c) / F.col("edge")) for c in AXES)).count()
    mean = sizes.groupBy("edge").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("mean"))
    fits = [r["edge"] for r in mean.where(F.col("mean") <= NEIGHBOURS + 1).collect()]
    return CELL_EDGES.index(max(fits)) if fits else 0


def _lists(places: DataFrame) -> DataFrame:
    """Places of each cell as one list."""
    return places.groupBy(*(f"c_{c}" for c in AXES)).agg(F.collect_list(F.struct("g_lat", "g_lon", "g_id")).alias("offers"))


def _around(places: DataFrame, edge: float) -> DataFrame:
    """Places in the 27 cells around their own, as one list a cell."""
    for c in AXES:
        own = F.floor(F.col(c) / edge).cast("int")
        places = places.withColumn(f"c_{c}", F.explode(F.array(own - 1, own, own + 1)))
    return _lists(places)


def _nearest(offered: DataFrame) -> DataFrame:
    """(id, best): the nearest of each row's list. Points and places never become rows of pairs."""
    return offered.select("id", F.array_min(F.transform("offers", lambda o: F.struct(
        haversine(F.col("lat"), F.col("lon"), o["g_lat"], o["g_lon"]).alias("angle"), o["g_id"].alias("g_id"),
        o["g_lat"].alias("g_lat"), o["g_lon"].alias("g_lon"),
    ))).alias("best"))


def _far(points: DataFrame, places: DataFrame, edge: float) -> DataFrame:
    """Nearest places of points that have none within `edge`.

    First against the cells that hold a place: the nearest of one known place per cell bounds the distance, and
    cells that begin beyond it are out. The sphere meets only so many cells of one edge, whatever the gazetteer
    holds, so this work grows with the points alone. Then the places of the cells that are left.
    """
    by_cell = places.select("g_lat", "g_lon", *AXES, *_cells(edge))
    names = [f"c_{c}" for c in AXES]
    held = by_cell.groupBy(*names).agg(F.min(F.struct(*AXES)).alias("one"))
    # At most 4 pi / edge^2 squares, each in a few cells: some thousand at the last edge, kept as one value.
    cells = held.agg(F.collect_list(F.struct(*names, "one"))).scalar()

    def gap(cell: Column) -> Column:
        beyond = [F.greatest(cell[f"c_{c}"] * edge - F.col(c), F.col(c) - (cell[f"c_{c}"] + 1) * edge, F.lit(0.0)) for c in AXES]
        return sum((x * x for x in beyond), F.lit(0.0))

    def known(cell: Column) -> Column:
        return sum(((F.col(c) - cell["one"][c]) * (F.col(c) - cell["one"][c]) for c in AXES), F.lit(0.0))

    bounds = points.withColumn("cells", cells).withColumn("most", F.array_min(F.transform("cells", known)))
    near = bounds.select(
        "id", "lat", "lon", F.explode(F.filter("cells", lambda cell: gap(cell) <= F.col("most") + 1e-9)).alias("c")
    ).select("id", "lat", "lon", *(F.col(f"c.{n}") for n in names))
    placed = _lists(places.withColumns(dict(zip(names, _cells(edge)))))
    return _nearest(near.join(placed, names))


def reverse_geocode(points: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Add `place` (country, region, city of the nearest gazetteer entry) to points with id, lat, lon.

    Equi joins on cells in space. A place no further than a cell's edge lies in one of the 27 cells around a
    point, so the nearest of those is the nearest of all; points without one go on to wider cells, and only they
    do. The first cells hold a few places each, however many there are, so that a point meets a short list. Places
    are copied, points never, and several places at one position count as the one with the smallest id. What is left
    after the widest cells goes through `_far`.
    """
    known = gazetteer.where("lat is not null and lon is not null").groupBy(
        F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")
    ).agg(F.min(F.struct(F.col("place_id").alias("g_id"), F.struct("country", "region", "city").alias("place"))).alias("p"))
    # Read once per round, so stored.
    known = cut_lineage(_on_sphere(known.select("g_lat", "g_lon", "p.g_id", "p.place"), "g_lat", "g_lon"))
    places = known.drop("place")
    open_points = cut_lineage(_on_sphere(
        points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon"), "lat", "lon"
    ))
    answers = None
    for edge in CELL_EDGES[_first_edge(places):]:
        joined = open_points.select("*", *_cells(edge)).join(_around(places, edge), [f"c_{c}" for c in AXES])
        settled = cut_lineage(_nearest(joined).where(F.col("best.angle") <= 2 * math.asin(edge / 2)))
        answers = settled if answers is None else answers.unionByName(settled)
        open_points = open_points.join(settled.select("id"), "id", "left_anti")
    answers = answers.unionByName(_far(cut_lineage(open_points), places, CELL_EDGES[-1]))
    best = answers.groupBy("id").agg(F.min("best").alias("best")).select("id", F.col("best.angle").alias("angle"), "best.g_lat", "best.g_lon")
    named = best.join(known.select("g_lat", "g_lon", "place"), ["g_lat", "g_lon"])
    return points.join(named.select("id", "place", "angle"), "id", "left")
