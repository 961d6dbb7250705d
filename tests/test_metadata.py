import math
import random

import pytest
from pyspark.sql import functions as F

from scenelake.functions import exif
from scenelake.operators.geo import reverse_geocode


def _value(spark, raw, make, kind="video", mtime=88.25):
    df = spark.createDataFrame([(raw, kind, mtime)], "raw map<string,string>, type string, mtime double")
    return df.select(exif.media_metadata(F.col("raw"), F.col("type"), F.col("mtime")).alias("m")).first()["m"][make]


@pytest.mark.parametrize("raw,field,expected", [
    ({"DateTimeOriginal": "2019:11:30 23:15:42", "OffsetTimeOriginal": "+05:30"}, "capture_ts", 1575135942.0),
    ({"DateTimeOriginal": "2019:11:30 23:15:42", "OffsetTimeOriginal": "+05:30"}, "capture_ts_source", "exif"),
    ({"DateTimeOriginal": "2019:11:30 23:15:42", "OffsetTimeOriginal": "05:30"}, "capture_ts", 1575175542.0),
    ({"CreateDate": "2019:11:30 23:15:42", "OffsetTimeOriginal": "noon"}, "capture_ts_source", "exif_naive"),
    ({"DateTimeOriginal": "yesterday"}, "capture_ts", 88.25),
    ({}, "capture_ts_source", "asset_mtime"),
    ({"Make": "  Fujifilm ", "Model": ""}, "camera_make", "Fujifilm"),
    ({"Model": "   ", "CameraModelName": " X-T4 "}, "camera_model", "X-T4"),
    ({"ICCProfileDescription": "Display P3 - x"}, "color_space", "DisplayP3"),
    ({"ColorSpace": "1"}, "color_space", "sRGB"), ({"ColorSpace": "2"}, "color_space", "AdobeRGB"),
    ({"ColorPrimaries": "bt.709"}, "color_space", "Rec709"), ({"TransferFunction": "BT.2020 x"}, "color_space", "Rec2020"),
    ({}, "color_space", "Unknown"),
    ({"GammaCurve": "S-Log3"}, "generation_hint", "original"),
    ({"VideoBitrate": "100000", "ImageWidth": "100", "ImageHeight": "100", "VideoFrameRate": "100"}, "generation_hint", "original"),
    ({"VideoBitrate": "10000", "ImageWidth": "100", "ImageHeight": "100", "VideoFrameRate": "100"}, "generation_hint", "proxy"),
    ({"VideoBitrate": "50000", "ImageWidth": "100", "ImageHeight": "100", "VideoFrameRate": "100"}, "generation_hint", "unknown"),
    ({"VideoFrameRate": "30/0", "FrameRate": "25"}, "frame_rate", 25.0),
    ({"Duration": "0:01:30"}, "duration_sec", 90.0), ({"Duration": "1:30.5"}, "duration_sec", 90.5),
    ({"Duration": "1:2:3:4"}, "duration_sec", None),
    ({"ExifImageWidth": "x", "ImageWidth": " 4000.9 "}, "resolution_w", 4000),
    ({"GPSLatitude": "nan", "GPSLongitude": "1"}, "gps_lon", None),
    ({"GPSLatitude": "40", "GPSLongitude": "-74"}, "gps_lat", 40.0),
])
def test_normalisation(spark, raw, field, expected):
    assert _value(spark, raw, field) == expected


def test_images_have_no_rate_or_duration(spark):
    raw = {"VideoFrameRate": "30000/1001", "Duration": "5"}
    assert _value(spark, raw, "frame_rate", "image") is None
    assert _value(spark, raw, "duration_sec", "image") is None
    assert _value(spark, raw, "frame_rate") == pytest.approx(29.97, abs=0.01)


def test_key_filter(spark):
    raw = {"SourceFile": "x", "MakerNotesBig": "x", "SERIAL": "1", "Make": "A"}
    df = spark.createDataFrame([(raw,)], "raw map<string,string>")
    assert df.select(exif.drop_vendor_keys(F.col("raw"), ["serial"])).first()[0] == {"Make": "A"}


def test_nearest_place_equals_brute_force(spark):
    rng = random.Random(11)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), "c", "r", f"p{i}") for i in range(60)]
    places += [(100, 90.0, 0.0, "c", "r", "pole"), (101, 0.0, 179.9, "c", "r", "edge"), (102, 0.2, -179.9, "c", "r", "edge2")]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    points += [(1000, 89.9, 170.0), (1001, -90.0, 0.0), (1002, 0.1, 180.0), (1003, 0.1, -180.0), (1004, None, 3.0)]

    def angle(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * math.asin(math.sqrt(min(1.0, h)))

    gaz = spark.createDataFrame(places, "place_id bigint, lat double, lon double, country string, region string, city string")
    pts = spark.createDataFrame(points, "id bigint, lat double, lon double")
    got = {r["id"]: r for r in reverse_geocode(pts, gaz).collect()}
    assert got[1004]["place"] is None and len(got) == len(points)
    for p in points[:-1]:
        assert got[p[0]]["angle"] == pytest.approx(min(angle(p, g) for g in places), abs=1e-9)


def test_nearest_place_equals_brute_force(spark):
    rng = random.Random(2)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)]
    places += [(1000 + i, 48 + rng.random() / 50, 2 + rng.random() / 50) for i in range(400)] + [(2000, 90.0, 0.0), (2001, 0.0, 180.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(100)]
    points += [(200 + i, 48 + rng.random() / 40, 2 + rng.random() / 40) for i in range(100)]
    points += [(400, -90.0, 5.0), (401, 89.99, -170.0), (402, 0.01, -179.999)]

    def angle(a, b):
        la, lo, ma, mo = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((ma - la) / 2) ** 2 + math.cos(la) * math.cos(ma) * math.sin((mo - lo) / 2) ** 2
        return 2 * math.asin(math.sqrt(min(1.0, h)))

    for known in (places, places[:3], places[:1]):
        pts = spark.createDataFrame(points, "id long, lat double, lon double")
        gaz = spark.createDataFrame(
            [(i, la, lo, "c", "r", str(i)) for i, la, lo in known],
            "place_id long, lat double, lon double, country string, region string, city string",
        )
        for r in reverse_geocode(pts, gaz).collect():
            point = next(p for p in points if p[0] == r["id"])
            assert abs(r["angle"] - min(angle(point, q) for q in known)) < 1e-9
            assert abs(angle(point, next(q for q in known if str(q[0]) == r["place"]["city"])) - r["angle"]) < 1e-9


def test_dense_places_are_looked_up_in_short_lists(spark):
    from scenelake.operators import geo

    rng = random.Random(5)
    spots = [(48 + rng.random() / 10, 11 + rng.random() / 10) for _ in range(400)] + [(-10.0, -20.0), (80.0, 5.0)]
    rows = [(i, *spots[i % len(spots)], "c", "r", f"p{i}") for i in range(3 * len(spots))]
    gaz = spark.createDataFrame(rows, "place_id long, lat double, lon double, country string, region string, city string")
    known = geo._on_sphere(gaz.select("place_id", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")), "g_lat", "g_lon")
    different = known.dropDuplicates(["g_lat", "g_lon"]).withColumnRenamed("place_id", "g_id")
    edge = geo.CELL_EDGES[geo._first_edge(different)]
    assert geo._around(different, edge).agg(F.max(F.size("offers"))).first()[0] < 100
    pts = [(i, 48 + rng.random() / 8, 11 + rng.random() / 8) for i in range(60)] + [(60 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)]
    got = {r["id"]: r["place"]["city"] for r in geo.reverse_geocode(spark.createDataFrame(pts, "id long, lat double, lon double"), gaz).collect()}

    def angle(a, b):
        (p, q), (s, t) = (map(math.radians, x) for x in (a, b))
        return math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2

    for i, lat, lon in pts:
        assert got[i] == f"p{min(range(len(spots)), key=lambda k: (angle((lat, lon), spots[k]), k))}"
