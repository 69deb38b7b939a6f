"""Polygon files and the projection."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from checks import shape_files
from tripcast.durable import new_folder
from tripcast.functions.projection import Conic
from tripcast.sources import shapes, zones

# The worked example of a published guidance note (Texas South Central, Clarke 1866, US survey feet)
TEXAS = Conic(20925832.164, 294.97870, 27 + 50 / 60, -99.0, 28 + 23 / 60, 30 + 17 / 60, 2_000_000.0, 0.0)


def degrees(spark, conic, points):
    lon, lat = conic.to_degrees(F.col("x"), F.col("y"))
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, x double, y double").select("i", lon.alias("lon"), lat.alias("lat"))
    return [(r.lon, r.lat) for r in rows.orderBy("i").collect()]


def test_a_published_point(spark):
    x, y = TEXAS.from_degrees(-96.0, 28.5)
    assert (round(x, 2), round(y, 2)) == (2963503.91, 254759.80)
    (lon, lat), = degrees(spark, TEXAS, [(2963503.91, 254759.80)])
    assert abs(lon + 96) < 1e-7 and abs(lat - 28.5) < 1e-7


def test_there_and_back(spark):
    """Far below a millimetre, also south of the equator and with a single parallel."""
    for conic, points in (
            (Conic.from_wkt(shape_files.LONG_ISLAND), [(-74.25, 40.5), (-73.7, 40.92), (-74.0, 40.1666), (-71.9, 41.3)]),
            (Conic(6378137.0, 298.257, -20.0, 130.0, -18.0, -36.0, 0.0, 0.0), [(130.0, -20.0), (115.1, -35.2), (150.5, -10.7)]),
            (Conic(6378137.0, 298.257, 46.5, 3.0, 46.5, 46.5, 7e5, 6.6e6), [(2.35, 48.85), (7.27, 43.7)])):
        back = degrees(spark, conic, [conic.from_degrees(*p) for p in points])
        assert max(abs(a - b) for p, q in zip(points, back) for a, b in zip(p, q)) < 1e-9


def test_projections_from_text():
    assert Conic.from_wkt('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]') is None
    conic = Conic.from_wkt(shape_files.LONG_ISLAND)
    assert conic.origin_lon == -74 and abs(conic.axis * 0.3048006096012192 - 6378137) < 1e-6
    with pytest.raises(ValueError, match="Transverse"):
        Conic.from_wkt('PROJCS["x",PROJECTION["Transverse_Mercator"]]')


@pytest.fixture
def files(spark):
    folder = new_folder(spark, "shapes")

    def put(name, content):
        shape_files.put(spark, f"{folder}/{name}", content)
        return f"{folder}/{name}"
    return put


SQUARE = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_rings_records_and_files(spark, files):
    hole = [(x / 2 + 0.25, y / 2 + 0.25) for x, y in reversed(SQUARE)]
    path = files("a.shp", shape_files.shape_bytes([None, [SQUARE, hole], [SQUARE]]))
    files("b.shp", shape_files.shape_bytes([[SQUARE]]))
    files("empty.shp", shape_files.shape_bytes([]))
    rows = shapes.read_polygons(spark, path.replace("a.shp", "*.shp")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.record, r.ring, r.seq)):
        got.setdefault((r.file[-1], r.record, r.ring), []).append((r.x, r.y))
    assert got == {("a", 2, 0): SQUARE, ("a", 2, 1): hole, ("a", 3, 0): SQUARE, ("b", 1, 0): SQUARE}


def test_polygons_with_heights_keep_their_plane(spark, files):
    plain = shape_files.shape_bytes([[SQUARE]])
    content = struct.pack("<i", 15) + plain[112:] + struct.pack("<7d", 0, 9, *range(5))
    path = files("z.shp", plain[:100] + struct.pack(">ii", 1, len(content) // 2) + content)
    assert [(r.x, r.y) for r in shapes.read_polygons(spark, path).orderBy("seq").collect()] == SQUARE


@pytest.mark.parametrize("content, what", [
    (b"not a shape file" * 20, "not a shape file"), (shape_files.shape_bytes([[SQUARE]])[:-8], "ends within record 1"),
    (shape_files.shape_bytes([[SQUARE]])[:100] + struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, 0, 0), "shape type 1")])
def test_broken_files_are_named(spark, files, content, what):
    path = files("broken.shp", content)
    with pytest.raises(Exception, match=what):
        shapes.read_polygons(spark, path).collect()


FIELDS = [("id", "N", 6, 0), ("name", "C", 12, 0), ("area", "N", 10, 3), ("ratio", "F", 12, 0), ("open", "L", 1, 0), ("since", "D", 8, 0)]


def test_attributes_of_every_kind(spark, files):
    path = files("t.dbf", shape_files.attribute_bytes(FIELDS, [
        ("7", "Ærø  x", "-1.25", "1e3", "T", "20240229"), ("8", "gone", "1", "1", "F", "20240101"), ("", "", "", "", "?", ""),
        ("-3", "last", "******", "2", "n", "19991231")], deleted={1}))
    rows = shapes.read_attributes(spark, path).orderBy("record").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (1, 7, "Ærø  x", -1.25, 1000.0, True, datetime.date(2024, 2, 29)), (3, None, None, None, None, None, None),
        (4, -3, "last", None, 2.0, False, datetime.date(1999, 12, 31))]


def test_zones_with_holes_parts_and_several_records(spark, files):
    """A zone of two squares, one with a hole, in two records: areas add, holes subtract."""
    hole = [(x / 2 + 0.5, y / 2 + 0.5) for x, y in reversed(SQUARE)]
    far = [(x + 3, y) for x, y in SQUARE]
    stem = files("zones.shp", shape_files.shape_bytes([[SQUARE, hole], [far], [SQUARE]])).removesuffix(".shp")
    files("zones.dbf", shape_files.attribute_bytes([("LocationID", "N", 4, 0)], [("5",), ("5",), ("6",)]))
    got = {r.zone_id: r for r in zones.zone_geometry(shapes.read_zone_vertices(spark, stem, "LocationID")).collect()}
    assert (got[6].cx, got[6].cy, got[6].minx, got[6].maxx) == (0.5, 0.5, 0.0, 1.0)
    # 1 at (0.5, 0.5), less 1/4 at (0.75, 0.75), plus 1 at (3.5, 0.5)
    assert got[5].cx == pytest.approx((0.5 - 0.1875 + 3.5) / 1.75) and got[5].cy == pytest.approx((0.5 - 0.1875 + 0.5) / 1.75)
    assert (got[5].minx, got[5].maxx, got[5].miny, got[5].maxy) == (0.0, 4.0, 0.0, 1.0)
